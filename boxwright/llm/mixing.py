"""Mixing sources to target weights by raking, made of DataFrame functions alone.

Documents fall into cells of source, language and topic.  The cells' tokens are raked
(iterative proportional fitting): for one dimension after another the wanted tokens of
each value's cells are scaled to the value's target, and no cell is asked for more
than it has.  A document is sampled with its cell's probability, wanted over present
tokens, by a hash of its id and text, so the sample is the same on every run.

Only cells (one row each) are shuffled; documents are read twice and never moved.  Up
to ``MOST_CELLS`` cells are raked in one task, more of them by the same windows over
as many tasks as there are.  Raking ends when no marginal moves by more than ``CLOSE``,
after ``ROUNDS`` rounds at the latest; ``marginals`` reports what each target got, so
targets that the caps or each other make infeasible show.

The topic is a given column expression; by default it is the form of the text
(``topic_of``), since the tables have no topic.

Defined results: a null source, language or id is a value of its own; a null text has
no tokens and is sampled like its cell (surely, if the cell has no tokens at all);
repeated rows are sampled alike; an empty table gives no rows.  Other columns pass
through, and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written
from .native import words

DIMS = ("source", "lang", "topic")
#: Exponents that temper the present shares into targets, and the part of all tokens to keep.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET = 0.6
ROUNDS, CLOSE = 40, 0.001
#: Rounds in one plan, and cells that may be broadcast or raked in one task.
STEP = 4
MOST_CELLS = 100_000

#: Topics by form, in order of precedence; a text is of the first whose pattern it holds.
TOPICS = [
    ("licence", r"(?i)\blicen[cs]e"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|\+\d{1,3} ?\("),
    ("table", r" \| [^|\n]{1,80} \| "),
    ("marked", r"[#$%&*]{3}"),
    ("shouted", r"\b\p{Lu}{4,} ?!!"),
]


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def keyed(docs: DataFrame, seed: int = 0, topic: Column | None = None) -> DataFrame:
    """(row, mix): each row of docs whole, and its cell, tokens and uniform draw; no name of docs can clash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cell = lambda c: F.coalesce(c.cast("string"), F.lit("\x00none"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), text), 11).cast("double") / float(1 << 53)
    fields = [cell(F.col("source")).alias("source"), cell(F.col("lang")).alias("lang"), cell(topic_of(text) if topic is None else topic).alias("topic"), F.size(words(text)).cast("bigint").alias("n"), draw.alias("u")]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(*fields).alias("mix"))


def targeted(cells: DataFrame, temper: dict[str, float], budget: float) -> DataFrame:
    """cells (source, lang, topic, n) with the tokens t_<dimension> that the cell's value of each dimension is to have: its present share to a power, of the budget."""
    for d in DIMS:
        have = cells.groupBy(d).agg(F.sum("n").cast("double").alias("have")).select(d, F.when(F.col("have") > 0, F.pow("have", F.lit(temper[d]))).otherwise(0.0).alias("p"))
        full = have.agg(F.sum("p")).first()[0] or 0.0
        cells = cells.join(have.select(d, (F.lit(budget) * F.col("p") / F.lit(full) if full else F.lit(0.0)).alias(f"t_{d}")), d)
    return cells


def rake(cells: DataFrame, budget: float, temper: dict[str, float]) -> DataFrame:
    """cells (source, lang, topic, n) with t_<dimension> and want: tokens to take, 0 to n, whose totals meet the targets where the caps allow."""
    state = written(targeted(cells, temper, budget).withColumn("want", F.col("n").cast("double")), "cells")
    together = state.count() <= MOST_CELLS
    columns = state.columns
    for done in range(0, ROUNDS, STEP):
        now = state.coalesce(1) if together else state
        now = now.withColumn("was", F.col("want"))
        for k in range(STEP):
            if k == STEP - 1:
                now = now.withColumn("was", F.col("want"))
            for d in DIMS:
                have = F.sum("want").over(Window.partitionBy(d))
                now = now.withColumn("want", F.least(F.col("n").cast("double"), F.coalesce(F.col("want") * F.try_divide(F.col(f"t_{d}"), have), F.lit(0.0))))
        now = written(now, "cells")
        drop_written(state)
        state = now.select(*columns)
        state._scratch = now._scratch
        moved = [now.groupBy(d).agg(F.abs(F.sum("want") - F.sum("was")).alias("by"), F.sum("was").alias("was")).select(F.max(F.try_divide("by", "was")).alias("m")) for d in DIMS]
        if all((m.first().m or 0.0) < CLOSE for m in moved):
            break
    return state


def marginals(raked: DataFrame) -> DataFrame:
    """(dimension, value, target, attained, present): in tokens; attained is less than target where caps or the other dimensions' targets hold it back."""
    out = None
    for d in DIMS:
        one = raked.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.max(f"t_{d}").alias("target"), F.sum("want").alias("attained"), F.sum("n").alias("present"))
        out = one if out is None else out.unionByName(one)
    return out


def probabilities(keyed_docs: DataFrame, budget: float = BUDGET, temper: dict[str, float] | None = None) -> DataFrame:
    """(source, lang, topic, p) and what it was raked from: the sampling probability of each cell."""
    cells = keyed_docs.groupBy(*(F.col(f"mix.{d}").alias(d) for d in DIMS)).agg(F.sum("mix.n").alias("n"))
    cells = written(cells, "cells")
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    raked = rake(cells, budget * total, temper or TEMPER)
    out = written(raked.withColumn("p", F.when(F.col("n") > 0, F.col("want") / F.col("n")).otherwise(1.0)), "rates")
    drop_written(raked, cells)
    return out


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows (row, mix) with p."""
    side = rates.select(F.struct(*DIMS).alias("cell"), "p")
    if rates.count() <= MOST_CELLS:
        side = F.broadcast(side)
    return rows.join(side, F.struct(*(F.col(f"mix.{d}").alias(d) for d in DIMS)) == F.col("cell")).drop("cell")


def mix(docs: DataFrame, budget: float = BUDGET, temper: dict[str, float] | None = None, seed: int = 0, topic: Column | None = None) -> DataFrame:
    """Per document row: doc_id, source, lang, topic, n_tokens, probability, selected."""
    stats = written(keyed(docs, seed, topic).select(F.struct(F.col("row.doc_id").cast("bigint").alias("doc_id"), "row.source", "row.lang").alias("row"), "mix"), "tokens")
    out = with_rates(stats, probabilities(stats, budget, temper))
    return out.select("row.*", F.col("mix.topic").alias("topic"), F.col("mix.n").alias("n_tokens"), F.col("p").alias("probability"), (F.col("mix.u") < F.col("p")).alias("selected"))


def sample(docs: DataFrame, budget: float = BUDGET, temper: dict[str, float] | None = None, seed: int = 0, topic: Column | None = None) -> DataFrame:
    """The sampled rows of docs, all columns."""
    rows = keyed(docs, seed, topic)
    return with_rates(rows, probabilities(rows, budget, temper)).where(F.col("mix.u") < F.col("p")).select("row.*")
