"""How filters interact: what each removes in every order, and its fair share of all that is removed.

The sets of filters applied so far are the states of a lattice; applying one
more filter is an edge.  A document's failed filters are a mask, so the table
shrinks to one count per part and mask, and everything else is read from it.
Paths are counted forward (orders that reach a state) and backward (orders that
lead on from a state); an edge's removals, weighted by both counts, add up to
the filter's removals over all orders (its Shapley value times their number),
and the steps of an order are the edges along its path.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.shared import id_of, plain, stored, table

LETTERS = "ABCDE"
#: Filters whose orders are listed: k filters have k! orders.
MOST_ORDERED = 7
_SPACE = " \t\n\x0b\x0c\r"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that need the text only, by letter; the text must not be null."""
    bare = F.btrim(text, F.lit(_SPACE))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    count = lambda x: F.when(bare == "", 0).otherwise(F.size(x)).cast("long")
    return {
        "A": count(words) < 200,
        "B": count(F.array_distinct(words)) * 100 < count(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def lattice(k: int) -> list[tuple[int, int, int, int]]:
    """(state, filter, orders that reach the state, orders that lead on from the state after) of every edge, by state and filter."""
    full = (1 << k) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for s in range(1, full + 1):
        forward[s] = sum(forward[s ^ (1 << f)] for f in range(k) if s >> f & 1)
    for s in range(full - 1, -1, -1):
        backward[s] = sum(backward[s | (1 << f)] for f in range(k) if not s >> f & 1)
    return [(s, f, forward[s], backward[s | (1 << f)]) for s in range(full + 1) for f in range(k) if not s >> f & 1]


def failure_masks(docs: DataFrame, parts: Column, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): counts of documents by part and mask of failed filters, bit i for letter i of ``LETTERS``.

    The last filter fails a text that a smaller id has, anywhere in the table.
    A null text is empty.  A row without an id neither fails the last filter nor
    makes another fail it, and has no label.  Rows that share an id are
    counted each.  Of several labels of an id the larger counts.

    Texts are compared by SHA-256 and never leave the task that reads them.  A
    text that many rows share is one row of the aggregation per task, and meets
    its smallest id by text and id, so it gathers in no task.
    """
    text = F.coalesce(plain(text_col).cast("string"), F.lit(""))
    fails = text_failures(F.col("text"))
    mask = sum((F.when(fails[x], 1 << i).otherwise(0) for i, x in enumerate(LETTERS[:-1])), F.lit(0))
    read = docs.select(id_of(id_col).alias("doc_id"), parts.alias("part"), text.alias("text"))
    alike = read.select("doc_id", "part", mask.cast("int").alias("fails"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    alike = stored(alike.groupBy("key", "doc_id", "part", "fails").agg(F.count("*").alias("n")), "failures")
    named = alike.where("doc_id is not null")
    first = named.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(id_of("doc_id").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    last = F.lit(1 << (len(LETTERS) - 1))
    judged = named.join(first, ["key", "doc_id"], "left").join(marks, "doc_id", "left")
    judged = judged.select("part", (F.col("fails") + F.when(F.col("first").isNull(), last).otherwise(0)).alias("fails"), "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = alike.where("doc_id is null").select("part", "fails", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    total = lambda c: F.sum(F.col("n") * F.col(c)).alias(c)
    return judged.unionByName(nameless).groupBy("part", "fails").agg(F.sum("n").alias("n"), total("good"), total("toxic"))


def edge_counts(masks: DataFrame, k: int) -> DataFrame:
    """(part, edges): per part what each edge of :func:`lattice` removes and keeps, in its order.

    An edge has state, filter, removed, good_lost, toxic_lost, kept, redundant
    (failing the filter, removed before) and weight (orders through the edge).
    A part has 2^k masks at most, so its edges are made from one small array.
    """
    edges = json.dumps([{"state": s, "filter": f, "weight": a * b} for s, f, a, b in lattice(k)])
    literal = F.from_json(F.lit(edges), "array<struct<state:int,filter:int,weight:bigint>>")
    held = masks.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("m"))

    def counts(e: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), e["filter"])
        before = lambda x: x["fails"].bitwiseAND(e["state"]) == 0
        fails = lambda x: x["fails"].bitwiseAND(bit) != 0
        total = lambda test, field: F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.when(test(x), x[field].cast("long")).otherwise(0))
        here = lambda x: before(x) & fails(x)
        return F.struct(
            e["state"].alias("state"), e["filter"].alias("filter"), e["weight"].alias("weight"), total(here, "n").alias("removed"), total(here, "good").alias("good_lost"),
            total(here, "toxic").alias("toxic_lost"), total(lambda x: before(x) & ~fails(x), "n").alias("kept"), total(lambda x: ~before(x) & fails(x), "n").alias("redundant"),
        )

    return held.select("part", F.transform(literal, counts).alias("edges"))


def shapley_sums(edges: DataFrame, letters: str) -> DataFrame:
    """(part, filter, removed): each filter's removals summed over all orders; divided by their number, its Shapley value."""
    e = edges.select("part", F.explode("edges").alias("e"))
    return e.groupBy("part", F.col("e.filter").alias("f")).agg(F.sum(F.col("e.weight") * F.col("e.removed")).alias("removed")).select("part", F.substring(F.lit(letters), F.col("f") + 1, F.lit(1)).alias("filter"), "removed")


def order_steps(edges: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    k = len(letters)
    if k > MOST_ORDERED:
        raise ValueError(f"{k} filters have too many orders to list; use edge_counts and shapley_sums")
    place = {(s, f): i for i, (s, f, _, _) in enumerate(lattice(k))}
    paths = []
    for order in permutations(range(k)):
        state = 0
        for step, f in enumerate(order, 1):
            alone = place[(1 << k) - 1 - (1 << f), f]
            paths.append({"o": "".join(letters[i] for i in order), "s": step, "f": f, "e": place[state, f], "u": alone})
            state |= 1 << f
    literal = F.from_json(F.lit(json.dumps(paths)), "array<struct<o:string,s:int,f:int,e:int,u:int>>")
    shares = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.aggregate("edges", F.lit(0).cast("long"), lambda s, e: s + F.when(e["filter"] == f, e["weight"] * e["removed"]).otherwise(0)))
    steps = edges.select("part", "edges", shares.alias("shares")).select("part", "edges", "shares", F.explode(literal).alias("p"))
    edge = F.get("edges", F.col("p.e"))
    return steps.select(
        "part", F.col("p.o").alias("filter_order"), F.col("p.s").alias("step"), edge["kept"].alias("kept"), edge["removed"].alias("removed"), edge["redundant"].alias("redundant"),
        F.get("edges", F.col("p.u"))["removed"].alias("unique_fails"), edge["good_lost"].alias("good_lost"), edge["toxic_lost"].alias("toxic_lost"), F.get("shares", F.col("p.f")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of :func:`order_steps` for the five filters of this module, per value of ``part_col`` (null: empty).

    A table without rows has no part and gives no row; a part that nothing is
    removed from has its rows with zeros.
    """
    parts = F.coalesce(plain(part_col).cast("string"), F.lit(""))
    return order_steps(edge_counts(failure_masks(docs, parts, labels, text_col, id_col), len(LETTERS)), LETTERS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {
    "op11_filter_audit": r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') as words from t),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
firsts as (select text, min(doc_id) as lowest from t group by 1),
f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) as c, regexp_matches(w.text, '[#$%&*|]') as d, coalesce(w.doc_id > lowest, false) as e
  from w join firsts on w.text = firsts.text left join marks using (doc_id)),
m as (select part, a, b, c, d, e, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select p.x || q.x || r.x || s.x || u.x as filter_order from l p, l q, l r, l s, l u where len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
k as (select filter_order, step, substr(filter_order, step, 1) as letter, substr(filter_order, 1, step - 1) as earlier from o, (select unnest(range(1, 6)) as step)),
x as (
  select m.*, filter_order, step, letter,
    case letter when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails,
    (a and contains(earlier, 'A')) or (b and contains(earlier, 'B')) or (c and contains(earlier, 'C')) or (d and contains(earlier, 'D')) or (e and contains(earlier, 'E')) as gone,
    a::int + b::int + c::int + d::int + e::int = 1 as single
  from m, k),
s as (
  select part, filter_order, step::int as step, letter,
    sum(case when not gone and not fails then n else 0 end)::bigint as kept, sum(case when not gone and fails then n else 0 end)::bigint as removed,
    sum(case when gone and fails then n else 0 end)::bigint as redundant, sum(case when single and fails then n else 0 end)::bigint as unique_fails,
    sum(case when not gone and fails then good else 0 end)::bigint as good_lost, sum(case when not gone and fails then toxic else 0 end)::bigint as toxic_lost
  from x group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, letter)::bigint as shapley from s
"""
}
