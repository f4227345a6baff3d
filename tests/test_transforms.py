import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as dt, numbers as nm, text as tx
from tidemark.operators import casting as cs, transforms as tf
from tidemark.plans.recipe import parse_recipe
from tidemark.types import ColumnSpec, SourceSpec, Transform, spec_problems


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [(1, "a", "10"), (2, "b", "x"), (3, None, "5"), (4, "a", "7")], "id int, name string, amount string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters_follow_null_rules(raw):
    assert ids(tf.filter_rows(raw, "amount", "ge", 7)) == [1, 4]
    assert ids(tf.filter_rows(raw, "name", "ne", "a")) == [2, 3]
    assert ids(tf.filter_rows(raw, "name", "not_in", values=["a"])) == [2, 3]
    assert ids(tf.filter_rows(raw, "name", "contains", "^[ab]$")) == [1, 2, 4]
    assert ids(tf.filter_rows(raw, "name", "eq", "a")) == [1, 4]


def test_first_row_wins(raw):
    assert ids(tf.drop_duplicates(raw, ["name"], "id")) == [1, 2, 3]


def test_rename_needs_the_column(raw):
    with pytest.raises(KeyError):
        tf.rename(raw, "gone", "x")


def test_combine_split_recode_scale(raw):
    r = {x["id"]: x for x in tf.combine(raw, ["amount", "id"], "s", "sum").collect()}
    assert r[2]["s"] == 2.0 and r[1]["s"] == 11.0
    p = {x["id"]: x for x in tf.combine(raw, ["amount", "id"], "s", "product").collect()}
    assert p[2]["s"] == 2.0 and p[3]["s"] == 15.0
    df = raw.sparkSession.createDataFrame([("a.b.c",), ("a",)], "t string")
    s = tf.split(df, "t", ["x", "y"], ".").orderBy("t").collect()
    assert (s[0]["x"], s[0]["y"], s[1]["x"], s[1]["y"]) == ("a", None, "a", "b")
    k = {x["id"]: x["name"] for x in tf.recode(raw, "name", {"a": "A"}, "other").collect()}
    assert k == {1: "A", 2: "other", 3: "other", 4: "A"}
    v = {x["id"]: x["amount"] for x in tf.scale(raw, "amount", 2, 1).collect()}
    assert v == {1: 21.0, 2: None, 3: 11.0, 4: 15.0}


def test_pivot_keeps_missing_cells_empty(spark):
    df = spark.createDataFrame([("w1", "google", 10.0), ("w1", "meta", 20.0), ("w2", "google", 15.0)], "week string, channel string, spend double")
    r = {x["week"]: x for x in tf.pivot(df, ["week"], "channel", "spend").collect()}
    assert r["w1"]["meta"] == 20.0 and r["w2"]["meta"] is None and r["w2"]["google"] == 15.0


def test_bad_transform_is_reported_and_skipped(raw):
    df, notes = tf.apply_transforms(raw, [Transform("scale", {"column": "nope", "factor": 2}), Transform("drop_columns", {"columns": ["name"]})], "s")
    assert df.columns == ["id", "amount"]
    assert [r["code"] for r in notes.collect()] == ["transform_error", "transform_applied"]


@pytest.mark.parametrize("texts,style,first", [
    ([f"€ 1.2{i:02d},50" for i in range(12)], "NL", 1200.5),
    ([f"{i},234.56" for i in range(1, 13)], "EN", 1234.56),
    (["n.v.t."] * 8, "plain", None),
    (["€ 12.50", "$ 3.00"], "currency", 12.5),
    (["1.234", "5.678,10", "9.876,00", "1.111,11", "2.222,22"], "NL", 1234.0),
])
def test_number_styles(spark, texts, style, first):
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "column string, i int, raw string")
    out = cs.coerce_cells(df, ["column"]).orderBy("i").collect()
    assert out[0]["style"] == style and out[0]["value"] == first


def test_strict_number_guard(spark):
    df = spark.createDataFrame([("1d",), ("NaN",), (" 2.5 ",), ("-1e3",), ("",)], "t string")
    assert [r[0] for r in df.select(nm.to_number(F.col("t"))).collect()] == [None, None, 2.5, -1000.0, None]


def test_dates_and_weeks(spark):
    df = spark.createDataFrame([("2025-12-30",), ("01/02/2024",), ("31-01-2024",), ("nope",)], "t string")
    r = [x[0] and x[0].date().isoformat() for x in df.select(dt.parse_date(F.col("t"))).collect()]
    assert r == ["2025-12-30", "2024-01-02", "2024-01-31", None]
    d = spark.sql("select date'2025-12-30' d")
    x = d.select(dt.iso_year("d"), dt.iso_week(F.col("d")), dt.monday_of(F.lit(2026), F.lit(1)), dt.week_start(F.lit("2024-01-07").cast("date"))).first()
    assert (x[0], x[1], str(x[2]), str(x[3])) == (2026, 1, "2025-12-29", "2024-01-01")


def test_slug_and_unique_names(spark):
    df = spark.createDataFrame([(1, "Black Friday-actie!"), (2, "Café crème"), (3, "!!!"), (4, "cafe creme")], "id int, t string")
    out = tx.unique_names(df.withColumn("slug", tx.slug(F.col("t"))).withColumn("k", F.lit(1)), ["k"], "slug", "id", "name")
    r = {x["id"]: x["name"] for x in out.collect()}
    assert r == {1: "black_friday_actie", 2: "cafe_creme", 3: "", 4: "cafe_creme_2"}


def test_unique_names_pass_over_used_numbers(spark):
    rows = list(enumerate(["a", "a", "a_2", "a", "b", "b", "a_4", "b_2_2", "b_2", "b_2"]))
    df = spark.createDataFrame([("k", i, n) for i, n in rows], "k string, id int, n string")
    out = {x["id"]: x["name"] for x in tx.unique_names(df, ["k"], "n", "id", "name").collect()}
    assert out == {0: "a", 1: "a_3", 2: "a_2", 3: "a_5", 4: "b", 5: "b_3", 6: "a_4", 7: "b_2_2", 8: "b_2", 9: "b_2_3"}
    taken = spark.createDataFrame([("k", "a"), ("k", "a_3")], "k string, n string")
    some = tx.unique_names(df.where("id < 2"), ["k"], "n", "id", "name", taken).collect()
    assert {x["name"] for x in some} == {"a_2", "a_4"}


def test_numbers_in_text(spark):
    df = spark.createDataFrame([(1, "van 1.234,5 naar 0.82 en 2,4 of 15 in 1.234.567")], "id int, t string")
    assert [r["number"] for r in nm.numbers_in(df, "t").collect()] == [1234.5, 0.82, 2.4, 15.0, 1234567.0]


def test_number_check_matches_brute_force(spark):
    facts = [100.0, 0.37, 2500.0, 13.1]
    numbers = [round(12.5 + 0.37 * i, 2) for i in range(400)] + [10000.0, 250000.0, 24.9, 2451.0, 2550.0]
    text = " ; ".join(f"{n:.2f}" for n in numbers)
    t = spark.createDataFrame([(1, text)], "doc int, t string")
    f = spark.createDataFrame([(1, x) for x in facts], "doc int, fact double")
    y = spark.createDataFrame([(1, 2024)], "doc int, year int")
    got = sorted(r["number"] for r in cs.number_check(t, "t", f, ["doc"], y).collect())
    allowed = [x * m for x in facts for m in (1, 100, 0.01)]
    want = sorted(n for n in numbers if not any(abs(a - n) <= 0.02 * max(1, a) for a in allowed))
    assert got == want


def test_problems_of_declared_sources():
    good = SourceSpec("s", (ColumnSpec("a", "kpi"), ColumnSpec("b", "control", fill="mean")))
    bad = SourceSpec("s", (ColumnSpec("a", "kpi", "x"), ColumnSpec("b", "spend", "x", "mean"), ColumnSpec("c", "price"), ColumnSpec("d", "control", fill="guess")))
    assert spec_problems([good]) == []
    assert spec_problems([good, bad, SourceSpec("e", ())]) == [
        ("source_named_twice", "s", None), ("output_named_twice", "s", "a"), ("fill_needs_control", "s", "b"), ("output_named_twice", "s", "b"),
        ("unknown_role", "s", "c"), ("unknown_fill", "s", "d"), ("source_without_columns", "e", None)]
    with pytest.raises(ValueError, match="fill_needs_control: s.b"):
        parse_recipe({"sources": [{"name": "s", "columns": [{"name": "b", "role": "spend", "fill": "zero"}]}]})


def test_declared_columns_and_collisions(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, a double")
    kept, issues = cs.project_declared(df, "s", [ColumnSpec("a", "kpi", "out"), ColumnSpec("b", "spend")], ["id"])
    assert kept.columns == ["id", "out"] and issues.first()["column"] == "b"
    c = spark.createDataFrame([("k", "s1", "x"), ("k", "s2", "x"), ("k", "s1", "y")], "k string, source string, series string")
    assert sorted(r["final_name"] for r in cs.rename_collisions(c, ["k"]).collect()) == ["s1_x", "s2_x", "y"]
