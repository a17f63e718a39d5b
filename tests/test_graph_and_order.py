"""Lists, classes of anonymous nodes, reachability along long chains, the order of literals, stored ranges."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dataward.functions.ordering import XSD, before, order_key
from dataward.operators import graph as G
from dataward.sources.range_store import OperationConflict, RangeStore

QUAD = "graph string, s string, s_kind string, p string, o string, o_kind string, datatype string, lang string"


def cells(spark, links, more=()):
    """links: cell -> (value, rest)."""
    rows = [("g", s, "bnode", G.RDF + "first", v, "literal", None, None) for s, (v, _) in links.items()]
    rows += [("g", s, "bnode", G.RDF + "rest", G.RDF + "nil" if r == "nil" else r, "bnode", None, None) for s, (_, r) in links.items() if r]
    return spark.createDataFrame(rows + list(more), QUAD)


def test_lists_share_tails_and_end_openly(spark):
    links = {"a": ("1", "b"), "b": ("2", "c"), "c": ("3", "nil"), "x": ("9", "b"), "o": ("5", "gone"), "r": ("6", "s"), "s": ("7", "t"), "t": ("8", "s"), "n": ("0", None)}
    use = [("g", "m", "iri", "urn:x:use", "c", "bnode", None, None)]
    members, faults = G.rdf_list(cells(spark, links, use))
    lists = {}
    for r in members.collect():
        lists.setdefault(r["head"], {})[r["pos"]] = r["value"]
    assert lists == {"a": {0: "1", 1: "2", 2: "3"}, "x": {0: "9", 1: "2", 2: "3"}, "c": {0: "3"}, "o": {0: "5"}, "n": {0: "0"}}
    assert sorted((r["cell"], r["code"]) for r in faults.collect()) == [("n", "LIST_CARDINALITY"), ("o", "LIST_OPEN"), ("r", "LIST_CYCLE"), ("s", "LIST_CYCLE"), ("t", "LIST_CYCLE")]


def test_signatures_of_deep_and_cyclic_nodes(spark):
    """Two chains of forty levels alike, one that differs at its bottom, and rings of two."""
    link = lambda s, o: ("g", s, "bnode", "urn:x:p", o, "bnode", None, None)
    leaf = lambda s, v: ("g", s, "bnode", "urn:x:v", v, "literal", None, None)
    rows = [link(f"{c}{i}", f"{c}{i + 1}") for c in "abz" for i in range(40)] + [leaf("a40", "1"), leaf("b40", "1"), leaf("z40", "2")]
    rows += [link("r", "s"), link("s", "r"), link("t", "u"), link("u", "t"), link("v", "w"), link("w", "v"), leaf("v", "1")]
    sig = {r["s"]: r["signature"] for r in G.node_signature(spark.createDataFrame(rows, QUAD)).collect()}
    assert len(sig) == 3 * 41 + 6
    assert sig["a0"] == sig["b0"] != sig["z0"] and sig["a7"] == sig["b7"] != sig["a8"]
    assert sig["r"] == sig["s"] == sig["t"] == sig["u"] and len({sig["r"], sig["v"], sig["w"]}) == 3


def test_a_chain_of_a_hundred_thousand_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: rounds.append(1) or real(df))
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    start = spark.createDataFrame([(5,)], "node long")
    assert G.reach(chain, start).count() == n - 4
    assert len(rounds) < 30  # of these at most 18 follow the chain


def test_reach_and_cycles_equal_brute_force(spark):
    rnd = random.Random(8)
    for n, m in ((30, 36), (40, 40), (25, 60)):
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)} | {(k, k + 1) for k in range(n, n + 9)} | {(n + 9, n + 4)}
        after = {}
        for a, b in edges:
            after.setdefault(a, set()).add(b)

        def reached(a, after=after):
            seen, todo = set(), list(after.get(a, ()))
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += after.get(x, ())
            return seen
        df = spark.createDataFrame(sorted(edges), "a long, b long")
        starts = [0, 3, n]
        got = {(r["start"], r["node"]) for r in G.reach_pairs(df, spark.createDataFrame([(s,) for s in starts], "node long")).collect()}
        assert got == {(s, x) for s in starts for x in reached(s) | {s}}
        nodes = {x for e in edges for x in e}
        assert {r["node"] for r in G.on_cycles(df).collect()} == {x for x in nodes if x in reached(x)}


def keyed(spark, rows):
    df = spark.createDataFrame([(i, t, XSD + k) for i, (t, k) in enumerate(rows)], "i int, t string, k string")
    return df.select("i", order_key(F.col("t"), F.col("k")).alias("key"))


def test_numbers_are_ordered_exactly(spark):
    rnd = random.Random(2)
    texts = ["0", "-0", "0.0", "+7", "9007199254740993", "9007199254740992.5", "9007199254740992", "-0.5", "-0.51", "-0.49", "1" + "0" * 60, "-1" + "0" * 60, ".5", "5.", "00012.500"]
    texts += [f"{rnd.choice(['', '-', '+'])}{rnd.randrange(10 ** rnd.randint(1, 25))}.{rnd.randrange(10 ** rnd.randint(1, 25)):0{rnd.randint(1, 25)}d}" for _ in range(40)]
    k = keyed(spark, [(t, "decimal") for t in texts])
    pairs = k.alias("x").join(k.withColumnRenamed("i", "j").withColumnRenamed("key", "other")).select("i", "j", before(F.col("key"), F.col("other")).alias("less"), before(F.col("key"), F.col("other"), False).alias("most"))
    for r in pairs.collect():
        a, b = Decimal(texts[r["i"]]), Decimal(texts[r["j"]])
        assert (r["less"], r["most"]) == (a < b, a <= b), (a, b)


def test_order_across_types_and_zones(spark):
    rows = [("1", "integer"), ("1.0", "decimal"), ("1.5E0", "double"), ("-INF", "double"), ("NaN", "double"), ("1e400", "double"), ("x", "integer"), ("1.5", "integer"),
            ("2024-05-01T00:00:00Z", "dateTime"), ("2024-05-01T09:00:00+09:00", "dateTime"), ("2024-05-01T13:00:00", "dateTime"), ("2024-05-01T14:00:00.1", "dateTime"),
            ("2024-04-30T24:00:00Z", "dateTime"), ("2024-05-01", "date"), ("2024-02-30", "date"), ("2024", "gYear"), ("true", "boolean"), ("b", "string"), ("2024-05-01T00:00:00", "date")]
    key = {r["i"]: r["key"] for r in keyed(spark, rows).collect()}
    assert [i for i, x in key.items() if x is None] == [4, 5, 6, 7, 14, 18]
    df = keyed(spark, rows)
    less = {(r["i"], r["j"]): r["x"] for r in df.join(df.withColumnRenamed("i", "j").withColumnRenamed("key", "o")).select("i", "j", before(F.col("key"), F.col("o")).alias("x")).collect()}
    same = lambda a, b: not less[a, b] and not less[b, a]
    assert same(0, 1) and less[0, 2] and less[3, 0] and not less[0, 8] and not less[13, 8]
    # The same instant twice and at the end of the day before; thirteen hours without zone are no order, more than fourteen are.
    assert same(8, 9) and same(8, 12) and same(8, 10) and less[8, 11] and not less[11, 8] and less[10, 11]


def test_stored_ranges_are_replaced_once_and_whole(spark, folder):
    def rows(*cells):
        return spark.createDataFrame([(m, f"2024-01-0{d} 0{h}:00:00", q) for m, d, h, q in cells], "meter string, t string, quantity int").select(
            "meter", F.col("t").cast("timestamp_ntz").alias("period_start"), "quantity")

    store = RangeStore(spark, f"{folder}/r")
    read = lambda: sorted((r["meter"], r["period_start"].day, r["period_start"].hour, r["quantity"]) for r in store.read().collect())
    assert store.read() is None
    store.store(rows(("m1", 1, 1, 1), ("m1", 1, 9, 3), ("m2", 1, 1, 4), ("m1", 2, 1, 5), ("m1", 3, 1, 6)), "first")
    span = ("2024-01-01 00:00:00", "2024-01-02 01:00:00")
    commit = store.replace(rows(("m1", 1, 2, 10), ("m1", 2, 1, 99), ("m2", 1, 1, 99)), "op", {"meter": "m1"}, *span)
    after = [("m1", 1, 2, 10), ("m1", 2, 1, 5), ("m1", 3, 1, 6), ("m2", 1, 1, 4)]
    assert read() == after and (commit["deleted"], commit["inserted"]) == (2, 1)
    # Repeated with other rows: nothing happens; the id for another range is refused.
    assert store.replace(rows(("m1", 1, 2, 77)), "op", {"meter": "m1"}, *span) == commit and read() == after
    with pytest.raises(OperationConflict):
        store.replace(rows(), "op", {"meter": "m2"}, *span)
    # An attempt that stops before its commit leaves the table, and can be made again.
    real, broken = RangeStore.log.fget(store).append, RuntimeError("lost")

    class Lost(type(store.log)):
        def append(self, number, commit):
            raise broken
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(RangeStore, "log", property(lambda self: Lost(self.spark, f"{self.root}/log")))
        with pytest.raises(RuntimeError):
            store.replace(rows(), "op2", {"meter": "m1"}, "2024-01-03 00:00:00", "2024-01-04 00:00:00")
    assert read() == after and store.done("op2") is None and callable(real)
    store.replace(rows(), "op2", {"meter": "m1"}, "2024-01-03 00:00:00", "2024-01-04 00:00:00")
    assert read() == after[:2] + after[3:] and "2024-01-03" not in store.log.latest()[1]["days"]
