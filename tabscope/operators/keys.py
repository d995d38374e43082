"""Key checks for lake tables without declared constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.local import local_frame


def check_primary_key(df: DataFrame, key: list[str] | str) -> DataFrame:
    """One row: ``rows, null_keys, duplicate_keys, duplicate_rows, is_primary_key``.

    ``duplicate_keys`` counts key values that occur more than once among rows
    with a complete key; a hot key costs one row per map task (partial agg).
    """
    key = [key] if isinstance(key, str) else list(key)
    complete = F.lit(True)
    for k in key:
        complete = complete & F.col(k).isNotNull()
    tagged = df.select(*key, complete.alias("_ok"))
    counts = tagged.where("_ok").groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    dup = counts.agg(
        F.count(F.when(F.col("_c") > 1, F.lit(1))).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).alias("duplicate_rows"),
    )
    tot = tagged.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col("_ok"), F.lit(1))).alias("null_keys"))
    r = tot.collect()[0]
    d = dup.collect()[0]
    row = (r["rows"], r["null_keys"], d["duplicate_keys"], int(d["duplicate_rows"]),
           r["null_keys"] == 0 and d["duplicate_keys"] == 0)
    return local_frame(df.sparkSession, 
        [row], "rows long, null_keys long, duplicate_keys long, duplicate_rows long, is_primary_key boolean"
    )


def check_foreign_key(child: DataFrame, child_key: list[str] | str, parent: DataFrame,
                      parent_key: list[str] | str) -> DataFrame:
    """One row: ``rows, null_keys, orphan_rows, orphan_keys``: child rows whose
    (complete) key has no parent row. Uses a left-anti join on the key."""
    ck = [child_key] if isinstance(child_key, str) else list(child_key)
    pk = [parent_key] if isinstance(parent_key, str) else list(parent_key)
    c = child.select(*[F.col(a).alias(f"_k{i}") for i, a in enumerate(ck)])
    complete = F.lit(True)
    for i in range(len(ck)):
        complete = complete & F.col(f"_k{i}").isNotNull()
    p = parent.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(pk)]).distinct()
    keys = [f"_k{i}" for i in range(len(ck))]
    # Collapse child rows to distinct keys first (a hot key becomes one row per
    # task map-side), so the anti-join is key against key, not row against key.
    child_keys = c.where(complete).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    orphans = child_keys.join(p, keys, "left_anti")
    o = orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows"),
                    F.count(F.lit(1)).alias("orphan_keys")).collect()[0]
    t = c.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(~complete, F.lit(1))).alias("null_keys")).collect()[0]
    return local_frame(child.sparkSession, 
        [(t["rows"], t["null_keys"], int(o["orphan_rows"]), o["orphan_keys"])],
        "rows long, null_keys long, orphan_rows long, orphan_keys long",
    )


# Kinds of values that can be keys; columns of different kinds are never compared.
_KINDS = {"tinyint": "whole", "smallint": "whole", "int": "whole", "bigint": "whole", "string": "text",
          "date": "date", "timestamp": "time", "timestamp_ntz": "time"}
# Estimated distinct counts have a standard error of 2 %; a claim is ruled out at ten of them.
_ERROR, _MARGIN = 0.02, 0.2
_LONG_TEXT = 64


# Claims of uniqueness are first tried on one in so many hashes of keys; masks of column sets have so many bits a word.
_SHARES, _BITS = 64, 62


def _key_part(fact: dict):
    """A column's value as part of a key, in a type that all columns of its kind share; long texts as their SHA-256."""
    c = F.col(f"`{fact['column']}`")
    if fact["type"] == "text":
        return F.when(F.length(c) > _LONG_TEXT, F.sha2(c, 256)).otherwise(c)
    return c.cast("bigint") if fact["type"] == "whole" else c


def _key_rows(cat, wanted: list[tuple[dict, list[dict]]]) -> DataFrame:
    """The tags and parts (``k0``, ``k1``) of every row's key for ``wanted`` (tags by name, facts of the key's columns).

    All keys have parts of the same types; one scan a table; rows with a null part are left out.
    """
    by_table: dict[str, list] = {}
    for tags, own in wanted:
        by_table.setdefault(own[0]["table"], []).append(F.struct(
            *[F.lit(v).cast("bigint").alias(n) for n, v in tags.items()], *[_key_part(f).alias(f"k{i}") for i, f in enumerate(own)]))
    rows = [cat.loaders[t](cat.spark).select(F.inline(F.array(*s))) for t, s in by_table.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.dropna(subset=[f"k{i}" for i in range(len(wanted[0][1]))])


def _repeated(cat, wanted: dict[int, list[dict]], shares: int) -> set[int]:
    """Ids of ``wanted`` (facts of the key's columns by id) with a key that occurs twice, among one in ``shares`` of all keys by hash."""
    by_types: dict[tuple, list] = {}
    for number, own in wanted.items():
        by_types.setdefault(tuple(f["type"] for f in own), []).append(({"id": number}, own))
    found = None
    for types, some in by_types.items():
        parts = [f"k{i}" for i in range(len(types))]
        rows = _key_rows(cat, some)
        if shares > 1:
            rows = rows.where(F.pmod(F.xxhash64(*parts), F.lit(shares)) == 0)
        twice = rows.groupBy("id", *parts).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        found = twice if found is None else found.unionByName(twice)
    return {r["id"] for r in found.distinct().collect()} if found is not None else set()


def _undisproved(cat, wanted: dict[int, list[dict]]) -> dict[int, list[dict]]:
    """Those of ``wanted`` that may be unique: a repeated key among the rows of one hash share disproves a claim,
    and only claims without one need be counted over all keys."""
    disproved = _repeated(cat, wanted, _SHARES)
    return {i: own for i, own in wanted.items() if i not in disproved}


def _column_facts(cat) -> list[dict]:
    """One entry a column that can be a key, from one scan a table: counts, range, estimated distinct values."""
    facts = []
    for table in cat.names:
        df = cat.loaders[table](cat.spark)
        columns = [(n, t, _KINDS[t]) for n, t in df.dtypes if t in _KINDS]
        if not columns:
            continue
        aggs = [F.count(F.lit(1))]
        for n, _, kind in columns:
            c = F.col(f"`{n}`")
            low = F.substring(c, 1, 256) if kind == "text" else c.cast("bigint") if kind == "whole" else c
            aggs += [F.count(c), F.min(low), F.max(low), F.approx_count_distinct(c, _ERROR)]
        r = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        for i, (n, t, kind) in enumerate(columns):
            count, low, high, about = r[1 + 4 * i:5 + 4 * i]
            facts.append({"id": len(facts), "table": table, "column": n, "type": t if kind == "time" else kind, "rows": r[0],
                          "count": count, "low": low, "high": high, "about": about})
    return facts


def find_keys(cat) -> DataFrame:
    """Keys and references of tables that declare none, found in their data.

    ``table, kind, columns, referred_table, referred_columns, distinct_values, referred_values``:

    * ``unique``: a column without nulls whose values occur once each; in a table
      without such a column, pairs of columns without nulls that do.
    * ``inclusion``: a column all of whose values (at least one) occur in another column that is
      unique by itself, with the distinct values of both; where the first are few
      of the second the two are often unrelated.

    Whole numbers, texts, dates and times take part. One scan a table takes counts,
    ranges and sketches; ranges and estimates ten standard errors off rule most columns out (a
    claim as far off as that would be missed). What is left is counted exactly, in the columns' own types:
    how often each key occurs; which columns hold each value, as a mask of bits that tasks merge before
    they shuffle; and how often each mask occurs. Empty tables have no keys. Only facts of columns and pairs of columns reach the driver.
    """
    facts = _column_facts(cat)
    full = [f for f in facts if f["rows"] and f["count"] == f["rows"]]
    likely = [f for f in full if f["about"] >= (1 - _MARGIN) * f["rows"]
              and (f["type"] != "whole" or f["high"] - f["low"] + 1 >= f["rows"])]
    left = _undisproved(cat, {f["id"]: [f] for f in likely})
    single = set(left) - _repeated(cat, left, 1)
    keyed = {f["table"] for f in facts if f["id"] in single}

    pairs = []
    for table in {f["table"] for f in full} - keyed:
        own = [f for f in full if f["table"] == table]
        fit = [(a, b) for i, a in enumerate(own) for b in own[i + 1:]
               if a["about"] * b["about"] >= (1 - _MARGIN) ** 2 * a["rows"]]
        for at in range(0, len(fit), 64):
            some = list(_undisproved(cat, dict(enumerate(fit[at:at + 64]))).values())
            if some:
                # Sketches of the pairs, a few dozen a scan: each keeps some kilobytes in a task.
                about = cat.loaders[table](cat.spark).agg(*[
                    F.approx_count_distinct(F.xxhash64(*[F.col(f"`{f['column']}`") for f in p]), _ERROR).alias(f"a{i}")
                    for i, p in enumerate(some)]).first()
                pairs += [p for p, n in zip(some, about) if n >= (1 - _MARGIN) * own[0]["rows"]]
    double = set(range(len(pairs))) - _repeated(cat, dict(enumerate(pairs)), 1)

    out = [(f["table"], "unique", [f["column"]], None, None, f["rows"], None) for f in facts if f["id"] in single]
    out += [(a["table"], "unique", [a["column"], b["column"]], None, None, a["rows"], None)
            for i, (a, b) in enumerate(pairs) if i in double]
    by_id = {f["id"]: f for f in facts}
    links = [(c["id"], p) for p in sorted(single) for c in facts
             if c["id"] != p and c["count"] and c["type"] == by_id[p]["type"] and by_id[p]["low"] <= c["low"]
             and c["high"] <= by_id[p]["high"] and c["about"] <= (1 + _MARGIN) * by_id[p]["rows"]]
    for child, parent, n in _included(cat, by_id, links):
        c, p = by_id[child], by_id[parent]
        out.append((c["table"], "inclusion", [c["column"]], p["table"], [p["column"]], n, p["rows"]))
    return local_frame(cat.spark, out, "table string, kind string, columns array<string>, referred_table string, "
                       "referred_columns array<string>, distinct_values long, referred_values long")


def _included(cat, by_id: dict, links: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(child, parent, distinct values)`` of those ``links`` where every value of the child is one of the parent's."""
    found = None
    for kind in sorted({by_id[c]["type"] for c, _ in links}):
        own = [link for link in links if by_id[link[0]]["type"] == kind]
        # The n-th column is one bit of one word.
        place = {i: (f"w{n // _BITS}", 1 << n % _BITS) for n, i in enumerate(sorted({i for link in own for i in link}))}
        words = sorted({w for w, _ in place.values()})
        values = _key_rows(cat, [({w: bit if w == word else 0 for w in words}, [by_id[i]]) for i, (word, bit) in place.items()])
        holders = values.groupBy("k0").agg(*[F.bit_or(w).alias(w) for w in words])
        ids = F.array_compact(F.array(*[F.when(F.col(w).bitwiseAND(F.lit(bit)) != 0, F.lit(i)) for i, (w, bit) in place.items()]))
        sets = holders.groupBy(*words).agg(F.count(F.lit(1)).alias("n")).select(ids.alias("ids"), "n")
        wanted = local_frame(cat.spark, own, "child int, parent int")
        each = sets.select("ids", "n", F.explode("ids").alias("child")).join(F.broadcast(wanted), "child")
        sums = each.groupBy("child", "parent").agg(
            F.sum("n").alias("values"), F.sum(F.when(F.array_contains("ids", F.col("parent")), F.col("n")).otherwise(0)).alias("held"))
        held = sums.where("values = held").select("child", "parent", "values")
        found = held if found is None else found.unionByName(held)
    return [tuple(r) for r in found.collect()] if found is not None else []
