"""Keys and inclusions found in data, against plain Python over every column and pair."""

import datetime as dt
import itertools
import random


def _tables():
    rng = random.Random(5)
    people = [(i, f"p{i}", rng.choice("ab"), "x" * 200 + str(i)) for i in range(400)]
    # A third of the sales belong to one person; a person's n-th sale is numbered n.
    who = [7 if i % 3 == 0 else rng.randrange(400) for i in range(3000)]
    seen = {}
    sales = []
    for w in who:
        seen[w] = seen.get(w, 0) + 1
        sales.append((w, seen[w], rng.choice([None, "p1", "p9"]), dt.date(2024, 1, 1)))
    notes = [(None, "x" * 200 + "3"), (5, "x" * 200 + "3"), (5000, None)]
    return {
        "people": (people, "id long, name string, letter string, essay string"),
        "sales": (sales, "who int, nth int, named string, day date"),
        "notes": (notes, "who long, quote string"),
        "nothing": ([], "id long, name string"),
        "nulls": ([(None,), (None,)], "id long"),
    }


def _brute(tables):
    cols = {}
    for t, (rows, ddl) in tables.items():
        for i, d in enumerate(ddl.split(", ")):
            n, k = d.split()
            cols[t, n] = ("whole" if k in ("int", "long") else k, [r[i] for r in rows])
    full = {c: v for c, (_, v) in cols.items() if v and None not in v}
    single = {c for c, v in full.items() if len(set(v)) == len(v)}
    out = {(t, "unique", (n,), None, None, len(full[t, n]), None) for t, n in single}
    for (a, b) in itertools.combinations(full, 2):
        if a[0] == b[0] and a[0] not in {t for t, _ in single} and len(set(zip(full[a], full[b]))) == len(full[a]):
            out.add((a[0], "unique", (a[1], b[1]), None, None, len(full[a]), None))
    for c, (k, v) in cols.items():
        values = set(v) - {None}
        for p in single - {c}:
            if values and cols[p][0] == k and values <= set(cols[p][1]):
                out.add((c[0], "inclusion", (c[1],), p[0], (p[1],), len(values), len(cols[p][1])))
    return out


def test_found_keys_equal_brute_force(spark):
    from tabscope.operators.keys import find_keys
    from tabscope.sources.catalog import Catalog, catalog_keys

    tables = _tables()
    cat = Catalog(spark)
    for name, (rows, ddl) in tables.items():
        cat.register(name, spark.createDataFrame(rows, ddl).repartition(3))
    got = {(r[0], r[1], tuple(r[2]), r[3], tuple(r[4]) if r[4] else None, r[5], r[6]) for r in find_keys(cat).collect()}
    assert got == _brute(tables)
    assert ("sales", "unique", ("who", "nth"), None, None, 3000, None) in got
    assert ("notes", "inclusion", ("quote",), "people", ("essay",), 1, 400) in got

    cat.keys["people"] = {"primary_key": ["id"], "foreign_keys": []}
    listed = catalog_keys(cat, discover=True).collect()
    assert [r["kind"] for r in listed if r["table"] == "people"] == ["primary"]
    assert ["who", "nth"] in [r["columns"] for r in listed if r["kind"] == "unique"]
    assert catalog_keys(cat).count() == 1


def test_no_tables_and_no_fitting_columns(spark):
    from tabscope.operators.keys import find_keys
    from tabscope.sources.catalog import Catalog

    assert find_keys(Catalog(spark)).collect() == []
    assert find_keys(Catalog(spark).register("t", spark.sql("SELECT 1.5D AS x"))).collect() == []


def test_keys_are_grouped_as_typed_values_and_disproved_pairs_are_not_counted_whole(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tabscope.operators import keys
    from tabscope.sources.catalog import Catalog

    # Of 6,000 rows each pair (a, b) comes twice, so one hash share holds such pairs; (a, c) comes once.
    twice = spark.range(6000).selectExpr("id % 60 AS a", "id % 3000 DIV 60 AS b", "id DIV 60 AS c")
    # One pair comes twice, and its hash is outside the first share.
    once = spark.range(5000).selectExpr("id DIV 50 AS d", "id % 50 AS e")
    spare = once.where(F.pmod(F.xxhash64("d", "e"), F.lit(64)) != 0).limit(1)
    cat = Catalog(spark).register("twice", twice).register("nearly", once.unionByName(spare))
    grouped, counted = [], []
    rows, repeated = keys._key_rows, getattr(keys, "_repeated", None)
    monkeypatch.setattr(keys, "_key_rows", lambda *a: grouped.append(rows(*a)) or grouped[-1])
    monkeypatch.setattr(keys, "_repeated", lambda c, wanted, shares: counted.append(
        (shares, sorted("".join(f["column"] for f in own) for own in wanted.values()))) or repeated(c, wanted, shares), raising=False)
    got = {(r["table"], r["kind"], tuple(r["columns"])) for r in keys.find_keys(cat).collect()}
    assert got == {("twice", "unique", ("a", "c"))}
    assert {t for df in grouped for _, t in df.dtypes} == {"bigint"}
    assert sorted(p for shares, pairs in counted if shares == 1 for p in pairs) == ["ac", "de"]


def test_inclusions_of_more_columns_than_bits_of_a_word(spark):
    from pyspark.sql import functions as F

    from tabscope.operators.keys import find_keys
    from tabscope.sources.catalog import Catalog

    # Columns k0 to k69 hold k % 7 + 1 of ten ids and a null; the last column holds a number that is no id.
    wide = spark.range(8).select(*[F.when(F.col("id") > 0, F.col("id") % (k % 7 + 1)).alias(f"k{k}") for k in range(70)],
                                 F.when(F.col("id") == 3, 9).otherwise(F.col("id") % 2).alias("off"))
    cat = Catalog(spark).register("wide", wide).register("ids", spark.sql("SELECT explode(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 11)) AS id"))
    got = {tuple(r["columns"]) + (r["distinct_values"], r["referred_values"]) for r in find_keys(cat).where("kind = 'inclusion'").collect()}
    assert got == {(f"k{k}", k % 7 + 1, 10) for k in range(70)}
