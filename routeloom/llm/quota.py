"""A sample that matches target shares of categories.

Quotas are allocated down a category tree (all, question type, split). What a
cell cannot fill passes first to its siblings under the same parent, then to
cousins; what no cell can take stays unmet and is reported. Records are drawn at
the leaves by a dense rank of permuted ids, found in two steps: hash buckets are counted per cell, and only records of one bucket
are ever ranked together, so a cell of any size is never sorted as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .labels import plain, split_name

#: Hash buckets of a cell; its ids are counted by bucket and ranked within one.
BUCKETS = 4096


def category_members(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (id, question_type, split) in the targets' spelling; rows whose labels name no target cell are left out."""
    names = targets.select(plain(F.col("question_type")).alias("kind"), F.col("question_type")).where(F.col("kind").isNotNull()).distinct()
    rows = questions.select(
        F.col("id").cast("string").alias("id"), plain(F.col("question_type").cast("string")).alias("kind"), split_name(F.col("split").cast("string")).alias("split")
    ).where(F.col("id").isNotNull())
    cells = targets.select(F.col("question_type"), F.col("split").alias("target_split"), split_name(F.col("split")).alias("split")).distinct()
    return (
        rows.join(F.broadcast(names), "kind")  # target cells: a stated, small table
        .join(F.broadcast(cells), ["question_type", "split"])
        .select("id", "question_type", F.col("target_split").alias("split"))
        .distinct()
    )


@dataclass
class Node:
    """A category: its children, or at a leaf its target cell and supply."""

    name: tuple[str, ...]
    children: list[Node] = field(default_factory=list)
    share: float = 0.0
    least: int = 0
    needed: int = 0
    supply: int = 0
    drawn: int = 0
    own: int = 0

    def leaves(self) -> list[Node]:
        return [self] if not self.children else [leaf for c in self.children for leaf in c.leaves()]

    def total(self, what: str) -> int:
        return sum(getattr(leaf, what) for leaf in self.leaves())

    def descend(self, quota: int) -> int:
        """Gives ``quota`` to the cells below, each up to its need; what they lack passes to siblings. Returns the rest."""
        if not self.children:
            self.own = self.drawn = min(quota, self.supply)
            return quota - self.drawn
        unmet = 0
        for child, part in zip(self.children, shared_out(quota, [(c.total("needed"), c.total("share"), c.total("least")) for c in self.children])):
            unmet += child.descend(part)
        return self.place(unmet)

    def place(self, rest: int) -> int:
        """Puts ``rest`` rows on cells with rows to spare, those with most first. Returns what finds no place."""
        for leaf in sorted(self.leaves(), key=lambda x: (x.drawn - x.supply, x.name)):
            take = min(rest, leaf.supply - leaf.drawn)
            leaf.drawn += take
            rest -= take
        return rest


def shared_out(quota: int, parts: list[tuple[int, float, int]]) -> list[int]:
    """``quota`` in parts: each its need where that fits; where needs were rounded up beyond it, those furthest above
    their share give a row back, none below its minimum. Parts are (needed, share, minimum)."""
    out = [n for n, _, _ in parts]
    whole = sum(share for _, share, _ in parts)
    excess = sum(out) - quota
    while excess > 0:
        free = [i for i in range(len(out)) if out[i] > parts[i][2]]
        if not free:
            break
        i = max(free, key=lambda i: (out[i] - (quota * parts[i][1] / whole if whole else 0.0), -i))
        out[i] -= 1
        excess -= 1
    return out


def category_tree(cells: list[dict]) -> Node:
    """The tree over (question_type, split) of the target cells, in name order."""
    root = Node(())
    kinds: dict[str, Node] = {}
    for c in sorted(cells, key=lambda c: (str(c["question_type"]), str(c["split"]))):
        kind = kinds.get(c["question_type"])
        if kind is None:
            kind = kinds[c["question_type"]] = Node((str(c["question_type"]),))
            root.children.append(kind)
        kind.children.append(
            Node((c["question_type"], c["split"]), share=c.get("target_share") or 0.0, least=c.get("min_rows") or 0, needed=c["needed"], supply=c["supply"])
        )
    return root


def allocated_leaves(cells: list[dict], sample_size: int | None = None) -> dict[tuple[str, str], Node]:
    """The leaf of each target cell with its rows to draw, after the quota went down the tree.

    ``cells`` are dicts with question_type, split, needed and supply, and where known target_share and min_rows. The
    root's quota is ``sample_size``, but at least the sum of the minimums; without it the sum of the needs. ``own`` is
    what a cell gives of its own quota, ``drawn`` that and what siblings and cousins passed to it. The list is the
    target table: bounded.
    """
    root = category_tree(cells)
    if root.children:
        quota = root.total("needed") if sample_size is None else max(min(sample_size, root.total("needed")), root.total("least"))
        root.descend(quota)
    return {leaf.name: leaf for leaf in root.leaves() if len(leaf.name) == 2}


def allocate(cells: list[dict], sample_size: int | None = None) -> dict[tuple[str, str], int]:
    """Rows to draw from each target cell, see ``allocated_leaves``."""
    return {name: leaf.drawn for name, leaf in allocated_leaves(cells, sample_size).items()}


def allocation_report(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """(question_type, split, target_share, min_rows, sample_size, available, needed, shortfall) of every target cell.

    Needed is the larger of min_rows and target_share times sample size, rounded up; the sample size is
    sample_fraction times all distinct ids, rounded down. An id counts in every cell it has a row in, whatever the
    spelling of its labels; ids whose labels are null or name no cell count in the sample size only. Null shares
    and minimums count as 0; repeated target rows count once. An empty table gives every cell an availability of 0.
    """
    total = questions.where(F.col("id").isNotNull()).agg(F.countDistinct("id").alias("ids"))
    counts = category_members(questions, targets).groupBy("question_type", "split").agg(F.count("*").alias("available"))
    share = F.coalesce(F.col("target_share"), F.lit(0.0))
    return (
        targets.select("question_type", "split", "target_share", "min_rows", "sample_fraction")
        .distinct()
        .join(F.broadcast(total))  # one row
        .withColumn("sample_size", F.floor(F.round(F.coalesce("sample_fraction", F.lit(0.0)) * F.col("ids"), 6)).cast("long"))
        .withColumn("needed", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.ceil(F.round(share * F.col("sample_size"), 6)).cast("long")))
        .join(counts, ["question_type", "split"], "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("shortfall", F.greatest(F.col("needed") - F.col("available"), F.lit(0)))
        .select("question_type", "split", "target_share", "min_rows", "sample_size", "available", "needed", "shortfall")
    )


ALLOCATION = "question_type string, split string, sample_size long, needed long, available long, shortfall long, home long, own long, drawn long, passed_in long, unmet long"


def allocation(questions: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[dict]]:
    """The home cells of the ids with their counts by hash bucket, and the tree's allocation, a row per target cell.

    Two allocations are made over the same tree. In the first every cell is offered its need against all ids that
    have a row in it: what it can't give of that is its ``shortfall``. In the second each id counts in its home cell
    only, the root's quota is the sample size, and unmet quota passes on: ``own`` and ``passed_in`` make ``drawn``,
    and ``unmet`` is what the cell lacked of its quota before passing; the sum of ``drawn`` is short of the sample size
    by what no cell could take.
    """
    report = cut_lineage(allocation_report(questions, targets))
    tight = report.select("question_type", "split", (F.col("available") / F.greatest(F.col("needed"), F.lit(1))).alias("ease"))
    home = (
        category_members(questions, targets)
        .join(F.broadcast(tight), ["question_type", "split"])
        .groupBy("id")
        .agg(F.min(F.struct("ease", "question_type", "split")).alias("h"))
        .select("id", F.col("h.question_type").alias("question_type"), F.col("h.split").alias("split"))
    )
    supply = {(r["question_type"], r["split"]): r["n"] for r in home.groupBy("question_type", "split").agg(F.count("*").alias("n")).collect()}
    cells = [r.asDict() for r in report.collect()]
    offered = allocated_leaves([{**c, "supply": c["available"]} for c in cells])
    size = max((c["sample_size"] for c in cells), default=0)
    drawn = allocated_leaves([{**c, "supply": supply.get((c["question_type"], c["split"]), 0)} for c in cells], size)
    rows = []
    for c in cells:
        key = (c["question_type"], c["split"])
        leaf = drawn[key]
        rows.append({
            "question_type": key[0], "split": key[1], "sample_size": c["sample_size"], "needed": c["needed"], "available": c["available"],
            "shortfall": max(0, offered[key].needed - offered[key].own), "home": leaf.supply, "own": leaf.own, "drawn": leaf.drawn,
            "passed_in": leaf.drawn - leaf.own, "unmet": max(0, min(leaf.needed, leaf.needed - leaf.own)),
        })
    return home, rows


def allocation_table(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """The allocation of every target cell, see ``allocation``. An empty target table gives no rows."""
    _, rows = allocation(questions, targets)
    return questions.sparkSession.createDataFrame([tuple(r[c.split()[0]] for c in ALLOCATION.split(", ")) for r in rows], ALLOCATION)


def unfilled_cells(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """(question_type, split, shortfall) of the target cells that can't give their need."""
    return allocation_table(questions, targets).where(F.col("shortfall") > 0).select("question_type", "split", "shortfall")


def hash_order(seed: int):
    """md5 of seed and id: a permutation that any engine reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")))


def quota_sample(questions: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(id, question_type, split): distinct ids drawn to the targets, as many as the sample size where the cells have them.

    An id with rows in several cells is drawn in one: the cell with the least availability for its need (ties by
    name). The draw depends on the ids and the seed only, not on the layout. Where the minimums add up to more than
    the sample size they are kept and the sample is larger.
    """
    home, rows = allocation(questions, targets)
    cell = ["question_type", "split"]
    home = cut_lineage(home.withColumn("order", hash_order(seed)).withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int")))
    counts = home.groupBy(*cell, "bucket").agg(F.count("*").alias("n"))
    quotas = questions.sparkSession.createDataFrame([(r["question_type"], r["split"], r["drawn"]) for r in rows], "question_type string, split string, quota long")
    before = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    starts = starts.join(F.broadcast(quotas), cell).where(F.col("start") < F.col("quota"))
    # At most BUCKETS rows per target cell.
    within = Window.partitionBy(*cell, "bucket").orderBy("order", "id")
    ranked = home.join(F.broadcast(starts), [*cell, "bucket"]).withColumn("rank", F.col("start") + F.row_number().over(within))
    return ranked.where(F.col("rank") <= F.col("quota")).select("id", *cell)
