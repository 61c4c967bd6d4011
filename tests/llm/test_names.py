import itertools
import random

from skillspark.llm.names import INITIAL, NEVER, Name, aligned, assignment, brand_keys, deletes, members, near, organisations, same_organisation, token_cost, variant_keys
from tests.conftest import rows

FIRM = ["Công ty TNHH Phần mềm Kifi Sopege", "Kifi Sopege Software Ltd", "KIFI-SOPEGE SOFTWARE CO., LTD", "KifiSopege SW", "Sopege Kifi Software", "Kifi Sopegee Software Limited", "K. Sopege Software Ltd", "Kifi Sopege Co Ltd"]
OTHER = ["Kifi Sopege Travel JSC", "CTCP Du lịch Kifi Sopege"]


def test_near():
    assert near("abc", "acb") and near("abc", "abcd") and near("abc", "ac") and near("abc", "axc") and near("", "a")
    assert not near("abc", "cba") and not near("abc", "abcde")
    assert deletes("ab") == {"ab", "a", "b"}


def test_long_texts_at_one_edit_share_a_key():
    text = "abcdefghij" * 6
    for i in range(len(text)):
        for other in (text[:i] + text[i + 1 :], text[:i] + "x" + text[i:], text[:i] + "x" + text[i + 1 :], text[:i] + text[i : i + 2][::-1] + text[i + 2 :]):
            assert near(text, other) and variant_keys(text) & variant_keys(other)
    assert len(variant_keys("A" * 20_000)) <= 4


def test_texts_about_the_limit_of_deletes_share_a_key():
    for n in range(39, 43):
        text = ("abcdefghij" * 5)[:n]
        for i in range(n):
            for other in (text[:i] + text[i + 1 :], text[:i] + "x" + text[i:], text[:i] + "x" + text[i + 1 :]):
                assert variant_keys(text) & variant_keys(other)


def test_alignment():
    assert aligned(["kifi", "sopege"], ["sopege", "kifi"])
    assert aligned(["kifi", "sopege"], ["kifisopgee"])
    assert not aligned(["kifi", "sopege"], ["kafo", "sopege"])


def test_assignment_is_the_cheapest_one():
    rng, tokens = random.Random(1), ["a", "ab", "abc", "b", "bc", "hoa", "hao", "h", "khang"]
    for _ in range(500):
        n = rng.randrange(5)
        a, b = ([rng.choice(tokens) for _ in range(n)] for _ in "ab")
        for initials in (False, True):
            want = min((sum(token_cost(x, y, initials) for x, y in zip(a, p)) for p in itertools.permutations(b)), default=0)
            assert abs(assignment(a, b, initials) - want) < 1e-6
    assert assignment(["k", "t", "phat"], ["thinh", "phatt", "khang"], initials=True) == 1 + 2 * INITIAL
    assert assignment(["a"], ["a", "b"]) >= NEVER
    assert aligned(["k", "phat"], ["phat", "khang"], initials=True) and not aligned(["k", "phat"], ["phat", "khang"])
    assert not aligned(["khamg", "phatt"], ["khang", "phat"])


def test_tokens_at_one_edit_share_a_key_in_any_order():
    for tokens in (["hoa", "sen"], ["hoa", "sen", "vang"], ["an", "binh", "chau", "duc", "em"]):
        for i, t in enumerate(tokens):
            for j in range(len(t)):
                other = tokens[:i] + [t[:j] + "x" + t[j + 1 :]] + tokens[i + 1 :]
                assert brand_keys(tokens) & brand_keys(other[::-1]) and aligned(tokens, other[::-1])


def test_brands_of_many_tokens_in_another_order(spark):
    for tokens in (["khang", "thinh", "hop", "gia"], [f"word{c}" for c in "abcdefghij"]):
        typo = [*tokens[1:], tokens[0][:-1]]
        assert aligned(tokens, tokens[::-1]) and aligned(tokens, typo) and brand_keys(tokens) & brand_keys(typo)
        assert not aligned(tokens, [*tokens[2:], "other", "names"])
    names = ["Khang Thinh Hop Gia Foods", "Gia Khang Thinh Hop Foods", "Thinh Hop Gia Khanh Foods"]
    assert len(rows(same_organisation(table(spark, names)))) == 3


def test_reading():
    n = Name("Cty Cổ phần Truyền thông Lộc Thủy (Việt Nam)")
    assert (n.brand, n.line, n.legal) == (["loc", "thuy"], "communications", "jsc")
    assert Name("Kifi Sopege Limitde").legal == "llc"
    assert Name("QSV - Quorvane Systems").brand == ["quorvane"]
    assert Name("Nhà Quờ (Quorvane)").alias == ["quorvane"]


def table(spark, names):
    return spark.createDataFrame([(x, 1) for x in names], "company string, root int")


def test_line_of_business_divides_a_brand(spark):
    found = {(a, b) for a, b in rows(same_organisation(table(spark, FIRM + OTHER)))}
    want = {tuple(sorted((a, b))) for group in (FIRM, OTHER) for a in group for b in group if a != b}
    assert found == want


def test_members_and_pairs_agree(spark):
    of = dict(members(table(spark, FIRM + OTHER + [None, " "])).collect())
    assert set(of) == set(FIRM + OTHER) and set(of.values()) == {min(FIRM), min(OTHER)}


def test_short_forms_and_aliases(spark):
    names = ["Wexbury & Tolland Consulting", "W&T Consulting", "Tolland & Wexbury", "Mộc Sao Retail", "MSR Group (Mộc Sao)", "Lac Hong Giang Bank", "LHGBank"]
    groups = {}
    for company, root, line in rows(organisations(table(spark, names))):
        groups.setdefault((root, line), set()).add(company)
    assert sorted(map(len, groups.values())) == [2, 2, 3]


def test_initials_with_vowels(spark):
    names = ["An Binh Chau Foods Ltd", "An Binh Chau Thuc pham", "ABC Foods", "AVA Foods", "Ava Foods", "An Viet Anh Foods", "OPI Travel"]
    groups = {}
    for company, root, line in rows(organisations(table(spark, names))):
        groups.setdefault((root, line), set()).add(company)
    assert {"ABC Foods", "An Binh Chau Foods Ltd", "An Binh Chau Thuc pham"} in groups.values() and {"AVA Foods", "Ava Foods"} in groups.values() and {"OPI Travel"} in groups.values()


def test_nulls_blanks_repeats_and_odd_texts(spark):
    names = [None, "", "  ", " ", "公司", "公司", "***", "A" * 20_000, "Acme Foods", "ACME FOODS", "ACME FOODS"]
    assert rows(same_organisation(table(spark, names))) == [("ACME FOODS", "Acme Foods")]


def test_empty(spark):
    assert rows(same_organisation(table(spark, []))) == []
