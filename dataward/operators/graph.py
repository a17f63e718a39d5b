"""Graph patterns, paths and digests over quads.

A quad frame has graph, s, s_kind, p, o, o_kind, datatype, lang (kinds iri, bnode, literal). Pattern
variables bind whole terms, as structs of kind, value, datatype and lang.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.lineage import cut_lineage, stored
from dataward.functions.skew import ordered_root

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"


def _term(kind: Column, value: Column, datatype: Column, lang: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), datatype.alias("datatype"), lang.alias("lang"))


def subject_term() -> Column:
    none = F.lit(None).cast("string")
    return _term(F.col("s_kind"), F.col("s"), none, none)


def object_term() -> Column:
    return _term(F.col("o_kind"), F.col("o"), F.col("datatype"), F.col("lang"))


# --- patterns --------------------------------------------------------------------------------

def pattern(q: DataFrame, triple: tuple[str, str, str]) -> DataFrame:
    """Bindings of one triple pattern; names starting with ``?`` are variables.

    Constants become filters on the scan, so they reach the file reader.
    """
    s, p, o = triple
    rows = q
    for name, text in (("s", s), ("p", p), ("o", o)):
        if not text.startswith("?"):
            rows = rows.where(F.col(name) == text)
    binds: dict[str, Column] = {}
    same = []
    none = F.lit(None).cast("string")
    for text, col in ((s, subject_term()), (p, _term(F.lit("iri"), F.col("p"), none, none)), (o, object_term())):
        if text.startswith("?"):
            name = text[1:]
            if name in binds:
                same.append(binds[name] == col)
            else:
                binds[name] = col
    for condition in same:
        rows = rows.where(condition)
    return rows.select(*[c.alias(n) for n, c in binds.items()]).distinct()


def bgp(q: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Conjunction of triple patterns, joined on shared variables; unconnected patterns are refused."""
    todo = [pattern(q, t) for t in patterns]
    out = todo.pop(0)
    while todo:
        linked = next((f for f in todo if set(f.columns) & set(out.columns)), None)
        if linked is None:
            raise ValueError("patterns without a shared variable would pair all rows")
        todo.remove(linked)
        out = out.join(linked, sorted(set(out.columns) & set(linked.columns)))
    return out


def optional(df: DataFrame, q: DataFrame, triple: tuple[str, str, str]) -> DataFrame:
    extra = pattern(q, triple)
    shared = sorted(set(df.columns) & set(extra.columns))
    if not shared:
        raise ValueError("an optional pattern needs a shared variable")
    return df.join(extra, shared, "left")


def values(df: DataFrame, var: str, terms: list[str]) -> DataFrame:
    """Keep bindings whose term is in an inline list."""
    return df.where(F.col(f"{var}.value").isin(terms))


def starts_with(df: DataFrame, var: str, prefix: str) -> DataFrame:
    return df.where(F.col(f"{var}.value").startswith(prefix))


def different(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.where(F.col(left) != F.col(right))


def ask(q: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """One row: does the pattern match anywhere?"""
    return bgp(q, patterns).limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def flat(df: DataFrame) -> DataFrame:
    """Bindings as plain text columns."""
    return df.select(*[F.col(f"{c}.value").alias(c) for c in df.columns])


# --- paths -----------------------------------------------------------------------------------

def path(q: DataFrame, expr) -> DataFrame:
    """Pairs (graph, s, s_kind, o, o_kind, datatype, lang) that a property path connects.

    ``expr`` is a predicate, or a tuple: ("seq", a, b, …), ("alt", a, b, …), ("inv", a),
    ("plus", a), ("star", a) or ("opt", a).
    """
    cols = ["graph", "s", "s_kind", "o", "o_kind", "datatype", "lang"]
    if isinstance(expr, str):
        return q.where(F.col("p") == expr).select(*cols).distinct()
    kind, *parts = expr
    none = F.lit(None).cast("string")
    if kind == "inv":
        inner = path(q, parts[0]).where(F.col("o_kind") != "literal")
        return inner.select("graph", F.col("o").alias("s"), F.col("o_kind").alias("s_kind"), F.col("s").alias("o"),
                            F.col("s_kind").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    if kind == "alt":
        return reduce(DataFrame.unionByName, [path(q, p) for p in parts]).distinct()
    if kind == "seq":
        out = path(q, parts[0])
        for p in parts[1:]:
            left = out.select("graph", "s", "s_kind", F.col("o").alias("_m"), F.col("o_kind").alias("_mk"))
            right = path(q, p).select("graph", F.col("s").alias("_m"), F.col("s_kind").alias("_mk"), "o", "o_kind", "datatype", "lang")
            out = left.join(right, ["graph", "_m", "_mk"]).select(*cols).distinct()
        return out
    if kind in ("plus", "star", "opt"):
        base = path(q, parts[0])
        if kind != "opt":
            ends = base.select(F.struct("graph", F.col("s_kind").alias("kind"), F.col("s").alias("value"), none.alias("datatype"), none.alias("lang")).alias("a"),
                               F.struct("graph", F.col("o_kind").alias("kind"), F.col("o").alias("value"), "datatype", "lang").alias("b"))
            # Pairs grow with the depth, so they are made of numbers; terms come back at the end.
            terms = cut_lineage(ends.select(F.col("a").alias("t")).union(ends.select(F.col("b").alias("t"))).distinct().withColumn("i", F.monotonically_increasing_id()))
            code = lambda name: terms.select(F.col("t").alias(name), F.col("i").alias(f"_{name}"))
            numbers = ends.join(code("a"), "a").join(code("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            pairs = closure(numbers).withColumnsRenamed({"a": "_a", "b": "_b"}).join(code("a"), "_a").join(code("b"), "_b")
            base = pairs.select("a.graph", F.col("a.value").alias("s"), F.col("a.kind").alias("s_kind"), F.col("b.value").alias("o"),
                                F.col("b.kind").alias("o_kind"), F.col("b.datatype").alias("datatype"), F.col("b.lang").alias("lang"))
        if kind == "plus":
            return base
        nodes = q.select("graph", "s", "s_kind").unionByName(
            q.where(F.col("o_kind") != "literal").select("graph", F.col("o").alias("s"), F.col("o_kind").alias("s_kind"))).distinct()
        zero = nodes.select("graph", "s", "s_kind", F.col("s").alias("o"), F.col("s_kind").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
        if kind == "opt":
            return base.unionByName(zero).distinct()
        # The pairs of a closure are distinct: only those from a node to itself can meet the zero paths.
        ring = base.where(F.col("s").eqNullSafe(F.col("o")) & F.col("s_kind").eqNullSafe(F.col("o_kind")) & F.col("datatype").isNull() & F.col("lang").isNull()).select(
            F.col("graph").alias("_g"), F.col("s").alias("_s"), F.col("s_kind").alias("_k"))
        apart = F.col("graph").eqNullSafe(F.col("_g")) & F.col("s").eqNullSafe(F.col("_s")) & F.col("s_kind").eqNullSafe(F.col("_k"))
        return base.unionByName(zero.join(ring, apart, "left_anti"))
    raise ValueError(f"unknown path form: {kind}")


# --- fixpoints -------------------------------------------------------------------------------

def closure(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """All (a, b) with a path from a to b, for class hierarchies and path expressions.

    Path lengths double each round, but only pairs that the round before found are joined with the others.
    Cycles end by themselves because pairs are distinct. The result holds every reachable pair, so use it on
    schema-sized relations; ``reach_pairs`` keeps the pairs of asked starts, ``reach`` marks nodes alone.
    """
    pairs = fresh = cut_lineage(edges.select("a", "b").distinct())
    for _ in range(rounds):
        ahead = fresh.select("a", F.col("b").alias("_m")).join(pairs.select(F.col("a").alias("_m"), "b"), "_m").select("a", "b")
        behind = pairs.select("a", F.col("b").alias("_m")).join(fresh.select(F.col("a").alias("_m"), "b"), "_m").select("a", "b")
        found = ahead.union(behind).withColumn("_old", F.lit(False)).union(pairs.withColumn("_old", F.lit(True)))
        fresh = cut_lineage(found.groupBy("a", "b").agg(F.bool_or("_old").alias("_old")).where("not _old").select("a", "b"))
        if fresh.isEmpty():
            return pairs
        pairs = cut_lineage(pairs.union(fresh))
    raise RuntimeError("closure did not settle; the relation is deeper than 2**rounds")


def superclasses(classes: DataFrame, equivalents: DataFrame | None = None) -> DataFrame:
    """(a, b): class a is b or a subclass of it, with equivalent classes followed as written."""
    edges = classes if equivalents is None else classes.unionByName(equivalents)
    own = edges.select(F.col("a").alias("a"), F.col("a").alias("b")).unionByName(edges.select(F.col("b").alias("a"), "b"))
    return closure(edges).unionByName(own).distinct()


def contract_chains(edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, inner): edges with every unbranched run put into one link.

    A node is inside a run if it has one link in and one out and is not in ``keep`` (node). ``inner`` gives for
    each such node the ``entry``, the nearest node before it that is not inside one, or NULL on a ring of inner
    nodes alone. Jumps back along a run double, so a run of n nodes takes log n rounds. ``links`` is (a, b, last):
    a to b, by way of the run that ends with ``last`` where that is not NULL.

    Rounds are stored, not checkpointed: a checkpoint keeps the estimate of its size, a join multiplies those of its
    sides, and an estimate squared by every round soon has more digits than the driver has memory.
    """
    edges = stored(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    into = edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("before")).where("n = 1").select("node", "before")
    inside = into.where("before != node").join(out, "node", "left_semi").join(keep.select("node").distinct(), "node", "left_anti")
    own = inside.select(F.col("node").alias("before"), F.lit(True).alias("_inner"))
    back = stored(inside.join(own, "before", "left").select("node", F.col("before").alias("entry"), F.col("_inner").isNull().alias("done")))
    waiting = back.where("not done").count()
    while waiting:
        there = back.select(F.col("node").alias("entry"), F.col("entry").alias("_entry"), F.col("done").alias("_done"))
        moved = back.where("not done").join(there, "entry").select("node", F.col("_entry").alias("entry"), F.col("_done").alias("done"))
        back = stored(back.where("done").unionByName(moved))
        now = back.where("not done").count()
        if now == waiting:  # a run that ends has a node at every distance, so what is left are rings
            break
        waiting = now
    inner = back.select("node", F.when(F.col("done"), F.col("entry")).alias("entry"))
    mark = inner.select("node", "entry", F.lit(True).alias("_in"))
    sides = edges.join(mark.select(F.col("node").alias("a"), "entry", F.col("_in").alias("_from")), "a", "left").join(
        mark.select(F.col("node").alias("b"), F.col("_in").alias("_to")), "b", "left").where("_to is null")
    links = sides.select(F.when(F.col("_from").isNull(), F.col("a")).otherwise(F.col("entry")).alias("a"), "b", F.when(F.col("_from"), F.col("a")).alias("last"))
    return stored(links), stored(inner)


def _reached(hops: DataFrame, begin: DataFrame, rounds: int) -> DataFrame:
    """All rows that follow from ``begin`` (node, and what to keep beside it) along ``hops`` (node, _next), each once.

    One link of every node is its main link, if possible one that leads on. Main links are followed by jumps that
    double, the other links by rounds: so rounds grow with the links beside main ones on a way, not with its length.
    Rounds are stored, as in ``contract_chains``.
    """
    hops = stored(hops)
    onward = hops.select(F.col("node").alias("_next"), F.lit(True).alias("_on")).distinct()
    choice = F.max_by("_next", F.struct(F.coalesce("_on", F.lit(False)), "_next"))
    jumps = [stored(hops.join(onward, "_next", "left").groupBy("node").agg(choice.alias("_next")))]
    side = stored(hops.join(jumps[0], ["node", "_next"], "left_anti"))
    rows = begin.columns
    seen, fresh = None, begin
    for _ in range(rounds):
        run, k = fresh, 0
        while True:
            # ``run`` holds what lies within 2**k - 1 main links of the fresh rows; all rows of ``seen`` have been followed.
            if k == len(jumps):
                jumps.append(stored(jumps[-1].withColumnRenamed("_next", "_m").join(
                    jumps[-1].select(F.col("node").alias("_m"), "_next"), "_m").select("node", "_next")))
            step = run.join(jumps[k], "node").drop("node").withColumnRenamed("_next", "node").select(*rows).distinct().join(run, rows, "left_anti")
            new = stored(step if seen is None else step.join(seen, rows, "left_anti"))
            if new.isEmpty():
                break
            run, k = run.unionByName(new), k + 1
        seen = run if seen is None else stored(seen.unionByName(run))  # the parts of the first run have been cut
        beside = run.join(side, "node").drop("node").withColumnRenamed("_next", "node").select(*rows).distinct()
        fresh = stored(beside.join(seen, rows, "left_anti"))
        if fresh.isEmpty():
            return seen
    raise RuntimeError("reachability did not settle")


def reach_pairs(edges: DataFrame, start: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(start, node): all nodes that each asked start (column node) reaches, itself included.

    Unbranched runs are contracted first, and main links are followed by doubling, so the rounds grow with the
    branchings on a way and not with its length; no pairs but the asked ones are kept.
    """
    start = cut_lineage(start.select("node").where("node is not null").distinct())
    links, inner = contract_chains(edges, start)
    hops = links.where("a is not null").select(F.col("a").alias("node"), F.col("b").alias("_next")).distinct()
    seen = _reached(hops, cut_lineage(start.select(F.col("node").alias("start"), "node")), rounds)
    return seen.unionByName(seen.withColumnRenamed("node", "entry").join(inner, "entry").select("start", "node"))


def reach(edges: DataFrame, start: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Nodes reachable from ``start`` (column node), itself included; one row per node. Rounds as ``reach_pairs``."""
    start = cut_lineage(start.select("node").where("node is not null").distinct())
    links, inner = contract_chains(edges, start)
    hops = links.where("a is not null").select(F.col("a").alias("node"), F.col("b").alias("_next")).distinct()
    seen = _reached(hops, start, rounds)
    return seen.unionByName(seen.withColumnRenamed("node", "entry").join(inner, "entry").select("node"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes (column node) that lie on a cycle.

    Runs are contracted; nodes without a link in or out are peeled off; pairs are formed only among the
    branching nodes that are left.
    """
    links, inner = contract_chains(edges, edges.select(F.col("a").alias("node")).limit(0))
    core = cut_lineage(links.select("a", "b").where("a is not null").distinct())
    size = core.count()
    while size:
        kept = core.join(core.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(
            core.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
        core = cut_lineage(kept)
        now = core.count()
        if now == size:
            break
        size = now
    rings = inner.where("entry is null").select("node")
    if not size:
        return rings
    pairs = closure(core)
    branching = pairs.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
    # A run lies on a cycle if its end is its entry or leads back to it.
    home = pairs.select(F.col("a").alias("b"), F.col("b").alias("a"))
    closed = links.where("last is not null").select("a", "b", "last")
    closed = closed.where("a = b").unionByName(closed.where("a != b").join(home, ["a", "b"], "left_semi").select("a", "b", "last"))
    back = edges.select("a", "b").distinct().join(inner.select(F.col("node").alias("a")), "a", "left_semi").join(inner.select(F.col("node").alias("b")), "b", "left_semi")
    runs = reach(back.select(F.col("b").alias("a"), F.col("a").alias("b")), closed.select(F.col("last").alias("node")))
    return rings.unionByName(branching).unionByName(runs).distinct()


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node of each connected component.

    Alternates two star steps. Every node links its larger neighbours to the least node around it,
    then its smaller ones; each minimum is a combinable aggregate and each node meets one minimum, so
    a hub with most of the edges costs no pairs.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    links = cut_lineage(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(frame: DataFrame):
        row = frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = mark(links)
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(lows, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct(F.col("a").alias("a"), F.col("_m").alias("b")))).alias("x")).select("x.a", "x.b")
        links = cut_lineage(small.where(F.col("a") != F.col("b")).distinct())
        after = mark(links)
        if after == before:
            return nodes.join(links.withColumnsRenamed({"a": "node", "b": "component"}), "node", "left").select(
                "node", F.coalesce("component", "node").alias("component"))
        before = after
    raise RuntimeError("components did not settle")


def replacement_chains(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings on replacements of deprecated terms: missing, self, cycle, no live end.

    ``terms``: node, deprecated. ``edges``: a is replaced by b. Nodes are marked, and unbranched chains are
    followed by doubling; pairs are formed only among the branching nodes of cycles.
    """
    old = terms.where("deprecated").select("node").distinct()
    links = edges.join(old.withColumnRenamed("node", "a"), "a", "left_semi").select("a", "b").distinct()
    missing = old.join(links.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.lit("REPLACEMENT_MISSING").alias("code"))
    own = links.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.lit("SELF_REPLACEMENT").alias("code"))
    live_ends = links.join(old.withColumnRenamed("node", "b"), "b", "left_anti").select(F.col("b").alias("node"))
    backwards = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    saved = reach(backwards, live_ends)
    stuck = links.select(F.col("a").alias("node")).distinct().join(saved, "node", "left_anti").select("node", F.lit("TERMINAL_MISSING").alias("code"))
    core = links.join(old.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    cycle = on_cycles(core).select("node", F.lit("REPLACEMENT_CYCLE").alias("code"))
    return missing.unionByName(own).unionByName(stuck).unionByName(cycle)


def rdf_list(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, faults): list members as graph, head, pos, value, value_kind; faulty cells with a code.

    A head is a cell that no rest points to, or that another statement than a rest points to. Every head gets its
    whole list, so lists with a common tail each have all of it. The jumps of all cells double; with them (head,
    cell) rows double as well, each made once, so a list of n cells takes log n rounds.

    Faults: LIST_CARDINALITY (not one first and one rest), LIST_CYCLE (the cell lies on a cycle or leads to one;
    its lists have no members), LIST_OPEN (the rest is neither another cell nor nil; members up to there stay).
    """
    rows, faults = list_rows(q)
    return rows.drop("cell"), faults


def whole_lists(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, heads): as ``rdf_list``, without lists that hold a faulty cell; heads as graph, head."""
    rows, faults = list_rows(q)
    bad = rows.join(faults.select("graph", "cell").distinct(), ["graph", "cell"], "left_semi").select("graph", "head").distinct()
    members = cut_lineage(rows.drop("cell").join(bad, ["graph", "head"], "left_anti"))
    return members, members.select("graph", "head").distinct()


def list_rows(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``rdf_list`` with their cell, and its faults."""
    cells = cut_lineage(q.where(F.col("p").isin(RDF + "first", RDF + "rest")).groupBy("graph", "s").agg(
        F.count_if(F.col("p") == RDF + "first").alias("_firsts"), F.count_if(F.col("p") == RDF + "rest").alias("_rests"),
        F.max(F.when(F.col("p") == RDF + "first", F.struct("o", "o_kind"))).alias("_first"),
        F.max(F.when(F.col("p") == RDF + "rest", F.col("o"))).alias("_rest")))
    broken = cells.where((F.col("_firsts") != 1) | (F.col("_rests") != 1)).select("graph", F.col("s").alias("cell"), F.lit("LIST_CARDINALITY").alias("code"))
    named = cells.select("graph", F.col("s").alias("to"), F.lit(True).alias("_cell"))
    after = cells.where(F.col("_rest").isNotNull() & (F.col("_rest") != RDF + "nil")).select("graph", F.col("s").alias("cell"), F.col("_rest").alias("to")).join(
        named, ["graph", "to"], "left")
    open_ = after.where("_cell is null").select("graph", "cell", F.lit("LIST_OPEN").alias("code"))
    jumps = [cut_lineage(after.where("_cell").select("graph", "cell", "to"))]
    counts = [jumps[0].count()]
    while counts[-1] and (len(counts) == 1 or counts[-1] != counts[-2]):
        # A chain that ends has a cell at every distance from its end: an unchanged number means cycles alone.
        last = jumps[-1]
        jumps.append(cut_lineage(last.select("graph", "cell", F.col("to").alias("_m")).join(
            last.select("graph", F.col("cell").alias("_m"), "to"), ["graph", "_m"]).select("graph", "cell", "to")))
        counts.append(jumps[-1].count())
    endless = jumps[-1].select("graph", "cell")
    cyclic = endless.withColumn("code", F.lit("LIST_CYCLE"))
    inside = cells.where("_rest is not null").select("graph", F.col("_rest").alias("s"))
    pointed = q.where((F.col("p") != RDF + "rest") & (F.col("o_kind") != "literal")).select("graph", F.col("o").alias("s"))
    heads = cells.select("graph", "s").join(inside, ["graph", "s"], "left_anti").unionByName(cells.select("graph", "s").join(pointed, ["graph", "s"], "left_semi")).distinct()
    rows = heads.select("graph", F.col("s").alias("head"), F.col("s").alias("cell"), F.lit(0).cast("bigint").alias("pos")).join(endless, ["graph", "cell"], "left_anti")
    for k, jump in enumerate(jumps):
        if not counts[k]:
            break
        step = rows.join(jump, ["graph", "cell"]).select("graph", F.col("to").alias("cell"), "head", (F.col("pos") + (1 << k)).alias("pos"))
        rows = cut_lineage(rows.unionByName(step))
    members = rows.join(cells.select("graph", F.col("s").alias("cell"), "_first"), ["graph", "cell"]).select(
        "graph", "head", "cell", "pos", F.col("_first.o").alias("value"), F.col("_first.o_kind").alias("value_kind"))
    return members, broken.unionByName(cyclic).unionByName(open_)


# --- digests ---------------------------------------------------------------------------------

def quad_text() -> Column:
    """One statement as canonical N-Quads text without the graph."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
    plain = F.col("datatype").isNull() | (F.col("datatype") == "http://www.w3.org/2001/XMLSchema#string")
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.lower("lang")))
                       .when(~plain, F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise(""))
    node = lambda kind, v: F.when(F.col(kind) == "bnode", F.concat(F.lit("_:"), v)).otherwise(F.concat(F.lit("<"), v, F.lit(">")))
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(node("o_kind", F.col("o")))
    return F.concat(node("s_kind", F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), obj, F.lit(" ."))


def graph_digest(q: DataFrame) -> DataFrame:
    """Order-free digest and size of each graph. Graphs must be ground: no anonymous nodes."""
    lines = q.select("graph", F.sha2(quad_text(), 256).alias("_line")).distinct()
    return ordered_root(lines, ["graph"], "_line").select("graph", F.col("root").alias("sha256"), F.col("row_count").alias("quads"))


def same_graphs(q: DataFrame) -> DataFrame:
    """One row: do all graphs hold the same statements?"""
    return graph_digest(q).agg(F.count(F.lit(1)).alias("graphs"), F.count_distinct("sha256").alias("digests")).withColumn(
        "equal", F.col("digests") <= 1)


def scope_blanks(q: DataFrame, document: Column) -> DataFrame:
    """Rename anonymous nodes so that those of different documents never meet."""
    fresh = lambda kind, v: F.when(F.col(kind) == "bnode", F.concat_ws("_", document.cast("string"), F.col(v))).otherwise(F.col(v))
    return q.withColumns({"s": fresh("s_kind", "s"), "o": fresh("o_kind", "o")})


def union_graphs(*graphs: DataFrame, name: str | None = None) -> DataFrame:
    merged = reduce(DataFrame.unionByName, graphs)
    return (merged.withColumn("graph", F.lit(name)) if name else merged).distinct()


def node_signature(q: DataFrame) -> DataFrame:
    """(graph, s, signature): structural digest of nodes; nested anonymous nodes count by content.

    Classes of nodes are refined: a node starts as the digest of its statements about named nodes and literals,
    and every round takes in the predicates and signatures of its anonymous values, until the number of classes
    stands still. So depth is not limited, and anonymous cycles are told apart as far as their statements differ.
    Statements of one node are added up, never listed, so a node may have any number. Signatures compare within
    one call, over all its graphs.
    """
    leaf = F.sha2(F.to_json(F.struct("p", "o_kind", "o", "datatype", "lang")), 256)
    fixed = ordered_root(q.where(F.col("o_kind") != "bnode").select("graph", "s", leaf.alias("_d")).distinct(), ["graph", "s"], "_d").select(
        "graph", "s", F.col("root").alias("_own"))
    # Stored, not checkpointed: estimates made before the statements were generated would broadcast all links and nodes.
    links = stored(q.where(F.col("o_kind") == "bnode").select("graph", "s", "p", F.col("o").alias("_child")).distinct())
    nodes = q.select("graph", "s").unionByName(links.select("graph", F.col("_child").alias("s"))).distinct()
    start = stored(nodes.join(fixed, ["graph", "s"], "left").select("graph", "s", F.coalesce("_own", F.lit("")).alias("signature")))
    # Only nodes on links between nodes can change.
    parents = links.select("graph", "s").distinct()
    moving = stored(start.join(parents, ["graph", "s"], "left_semi"))
    still = start.join(parents, ["graph", "s"], "left_anti")
    leaves = stored(still.join(links.select("graph", F.col("_child").alias("s")).distinct(), ["graph", "s"], "left_semi"))
    half = lambda salt: F.sum(F.xxhash64(F.lit(salt), "p", "signature").cast("decimal(38,0)"))
    classes = moving.agg(F.count_distinct("signature").alias("n")).first()["n"]
    while classes:
        values = links.join(moving.unionByName(leaves).select("graph", F.col("s").alias("_child"), "signature"), ["graph", "_child"])
        sums = values.groupBy("graph", "s").agg(half(1).alias("_x"), half(2).alias("_y"), F.count(F.lit(1)).alias("_n"))
        moving = stored(moving.join(sums, ["graph", "s"]).select(
            "graph", "s", F.sha2(F.concat_ws("|", "signature", F.col("_x").cast("string"), F.col("_y").cast("string"), F.col("_n").cast("string")), 256).alias("signature")))
        now = moving.agg(F.count_distinct("signature").alias("n")).first()["n"]
        if now == classes:
            break
        classes = now
    return still.unionByName(moving).join(q.select("graph", "s").distinct(), ["graph", "s"], "left_semi").select("graph", "s", "signature")


def anchors(q: DataFrame) -> DataFrame:
    """(graph, node, anchor): named ancestors of anonymous nodes with the predicates in between.

    Ways go up to any depth; a way that comes back to a node it has passed is not followed further.
    """
    up = cut_lineage(q.where(F.col("o_kind") == "bnode").select("graph", F.col("o").alias("_at"), F.col("s").alias("_up"), F.col("s_kind").alias("_up_kind"), "p").distinct())
    walk = up.select("graph", F.col("_at").alias("node"), "_up", "_up_kind", F.col("p").alias("_path"), F.array("_at").alias("_passed"))
    found = None
    while True:
        hit = cut_lineage(walk.where(F.col("_up_kind") == "iri").select("graph", "node", F.concat_ws("|", "_up", "_path").alias("anchor")).distinct())
        found = hit if found is None else found.unionByName(hit)
        pending = walk.where((F.col("_up_kind") == "bnode") & ~F.array_contains("_passed", F.col("_up"))).select(
            "graph", "node", F.col("_up").alias("_at"), "_path", F.array_append("_passed", F.col("_up")).alias("_passed"))
        walk = cut_lineage(pending.join(up, ["graph", "_at"]).select(
            "graph", "node", "_up", "_up_kind", F.concat_ws("|", "p", "_path").alias("_path"), "_passed").distinct())
        if walk.isEmpty():
            return found.distinct()
