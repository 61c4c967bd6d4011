"""PySpark-native engine for integrating job postings and analysing skill demand."""
