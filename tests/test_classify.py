import pytest

from bidscope.functions.classify import (PatternError, merge_patterns, normalize_opportunity_type,
                                         normalize_set_aside, SET_ASIDE_BUCKETS)

EDWOSB = "SBA Certified Economically Disadvantaged WOSB (EDWOSB) Program Set-Aside (FAR 19.15)"


def classify_sa(spark, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                               "i int, TypeOfSetAsideDescription string")
    out = normalize_set_aside(df, **kw).orderBy("i")
    return [r["Normalized_Set_Aside"] for r in out.collect()]


def classify_ty(spark, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, Type string")
    out = normalize_opportunity_type(df, **kw).orderBy("i")
    return [r["Normalized_Opportunity_Type"] for r in out.collect()]


def test_set_aside_edge_rows(spark):
    # Q3: SQL NULL -> NO SET-ASIDE; blank / token text (any whitespace) -> NULL.
    got = classify_sa(spark, [None, "\t N/A \n", "", "None", "NULL", "Service-Disabled Vet",
                              "Women-Owned", EDWOSB, "Economically disadvantaged concern",
                              "8(a) Set-Aside", "Unrestricted", "100% Small Business"])
    assert got == [
        "NO SET-ASIDE", None, None, None, None, "SDVOSB", "WOSB",
        "WOSB",  # Q4: "wosb" bucket comes first
        EDWOSB, "NO SET-ASIDE", "NO SET-ASIDE", "TOTAL SMALL BUSINESS SET ASIDE"]


def test_longest_match(spark):
    assert classify_sa(spark, [EDWOSB], match="longest") == [EDWOSB]
    assert classify_ty(spark, ["Presolicitation"], match="longest") == ["Presolicitation"]
    assert classify_ty(spark, ["Presolicitation"]) == ["Solicitation"]  # Q5


def test_type_edge_rows(spark):
    got = classify_ty(spark, [None, "Surfing equipment", "Combined Synopsis/Solicitation",
                              "Award Notice", "RFI"])
    assert got == ["Other", "Sources Sought", "Solicitation", "Other", "Sources Sought"]  # Q6


def test_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "i int")
    notes = []
    assert normalize_set_aside(df, notes=notes).first()["Normalized_Set_Aside"] is None
    assert normalize_opportunity_type(df).first()["Normalized_Opportunity_Type"] == "Other"
    assert notes


def test_pattern_merge():
    notes = []
    merged = merge_patterns(SET_ASIDE_BUCKETS, {" WOSB ": ["woman-owned", ""],
                                                "8(A)": ["8(a)"], "EMPTY": []}, notes)
    names = [b for b, _ in merged]
    assert names[-1] == "8(A)" and "EMPTY" not in names
    assert dict(merged)["WOSB"][-1] == "woman-owned"
    assert notes  # the empty pattern was dropped and noted
    with pytest.raises(PatternError):
        merge_patterns(SET_ASIDE_BUCKETS, {"X": "abc"})  # Q7: bare string rejected


def test_plan_patterns_applied(spark):
    got = classify_sa(spark, ["8(a) Set-Aside"], extra_patterns={"8(A) PROGRAM": ["8(a)"]})
    assert got == ["8(A) PROGRAM"]


def test_many_patterns_use_one_regex(spark):
    pats = {"MANY": [f"code{i}." for i in range(40)] + ["a+b"]}
    got = classify_sa(spark, ["has code17. inside", "a+b", "ab"], extra_patterns=pats)
    assert got == ["MANY", "MANY", "NO SET-ASIDE"]
