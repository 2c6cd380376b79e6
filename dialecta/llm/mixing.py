"""Problem 8: mixing sources to target weights.

Hierarchical budgeting over a tree of groups (domain, language, source; see
``budget``). Every node's weight is its share of its parent; the budget flows down, a node takes
at most ``repeats x size`` of its leaves, and what it cannot take goes first to
its siblings in proportion to their weights, only then to the siblings of its
ancestors. Each leaf is filled from seeded epochs: all of its records as often
as they fit, then the prefix of a seeded order up to the remaining tokens.

The tree reaches the driver as one row per leaf; records never do. A prefix is
found from token sums of ``BUCKETS`` hash ranges per leaf, and only the one
bucket that the border cuts is summed row by row.

Defined results: records of groups without a target (null ones too) take no
part; a group without records has no size; empty texts are used like others and
add nothing; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialecta.llm.tokens import DEFAULT_TOKENIZER, token_counts
from dialecta.tables import written

BUCKETS = 4096


@dataclass
class Node:
    """A group: its weight among its siblings, what it can take at most, and its children."""

    name: str
    weight: float
    most: float = 0.0
    children: list["Node"] = field(default_factory=list)
    key: tuple[str, str] | None = None  # (source, language) of a leaf
    given: float = 0.0
    asked: float = 0.0  # its own part of the budget, before shortages of others are passed on

    @property
    def short(self) -> bool:
        return self.capacity() < self.asked

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children) if self.children else self.most


def distribute(node: Node, budget: float) -> float:
    """Gives the budget to the node's leaves; returns what could not be placed.

    Every child is asked for its share first. What a child cannot take goes to the other children by their
    weights; what none of them can take is the caller's, that is the node's siblings'.
    """
    weights = sum(c.weight for c in node.children)
    for c in node.children:
        c.asked = budget * c.weight / weights if weights else 0.0
    if not node.children:
        node.given = min(budget, node.most)
        return budget - node.given
    shares = {id(c): 0.0 for c in node.children}
    rest, able = budget, [c for c in node.children if c.capacity() > 0 and c.weight > 0]
    while able and rest > 1e-9:
        total = sum(c.weight for c in able)
        part = rest
        for c in able:
            more = min(part * c.weight / total, c.capacity() - shares[id(c)])
            shares[id(c)] += more
            rest -= more
        able = [c for c in able if c.capacity() - shares[id(c)] > 1e-9]
    for c in node.children:
        rest += distribute(c, shares[id(c)])
    node.given = sum(c.given for c in node.children)
    return rest


def _label(c: str):
    v = F.lower(F.trim(F.col(c)))
    return F.coalesce(F.when(v != "", v), F.lit("?"))


def sized(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, targets: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(rid, n_tokens, source, lang) of the records whose source has a target."""
    wanted = F.broadcast(targets.select(F.col("source").alias("want")).distinct())  # a fixed list
    mine = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("txt"), F.col(source_col).alias("source"), _label(lang_col).alias("lang"))
    mine = mine.join(wanted, F.col("source") == F.col("want"), "left_semi")
    return written(token_counts(mine, "rid", "txt", "source", "lang", tokenizer=tokenizer), "mix-sizes")


def budget(sizes: DataFrame, targets: DataFrame, weights: DataFrame | None = None, smoothing: float = 0.5) -> tuple[Node, int]:
    """The filled tree domain - language - source and the total number of tokens to mix.

    ``weights`` (domain, lang, source, weight) states what each leaf should contribute; a node weighs what its leaves
    do. Without it every source is a domain of its own with its target share, and its languages weigh their tokens to
    the power of ``smoothing``, so that small languages are asked for more than they hold, run out of repeats, and
    leave their shortage to the other languages of the source before any other source.
    """
    rows = sizes.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).collect()  # one row per leaf
    have = {(r["source"], r["lang"]): r["n"] for r in rows}
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect()}
    total = sum(have.values())
    root = Node("all", 1.0)
    if weights is not None:
        for r in sorted(weights.collect(), key=lambda r: (r["domain"], r["lang"], r["source"])):
            node = root
            for name in (r["domain"], r["lang"]):
                child = next((c for c in node.children if c.name == name), None)
                if child is None:
                    child = Node(name, 0.0)
                    node.children.append(child)
                child.weight += r["weight"]
                node = child
            node.children.append(Node(r["source"], r["weight"], float(have.get((r["source"], r["lang"]), 0)) * wanted.get(r["source"], (0, 1))[1], key=(r["source"], r["lang"])))
    else:
        for source, (share, repeats) in sorted(wanted.items()):
            own = sorted((lang, n) for (s, lang), n in have.items() if s == source)
            root.children.append(Node(source, share, children=[Node(lang, float(n) ** smoothing, float(n) * repeats, key=(source, lang)) for lang, n in own]))
    distribute(root, float(total))
    return root, total


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_tokens, reachable, planned_tokens, planned_share, short): one row per target."""
    root, total = budget(sizes, targets)
    spark = sizes.sparkSession
    have = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    repeats = {r["source"]: r["max_repeats"] for r in targets.collect()}
    rows = []
    for c in root.children:
        n = have.get(c.name, 0)
        reachable = n * repeats[c.name]
        short = c.short or not c.children and c.weight > 0
        rows.append((c.name, c.weight, repeats[c.name], n, reachable, int(c.given), c.given / root.given if root.given else 0.0, short))
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, n_tokens long, reachable long, planned_tokens long, planned_share double, short boolean")


def mixed(sizes: DataFrame, targets: DataFrame, seed: int = 17, weights: DataFrame | None = None) -> DataFrame:
    """(rid, source, lang, n_tokens, uses): how often each record is used; records of no use are left out."""
    spark = sizes.sparkSession
    root, _ = budget(sizes, targets, weights)
    per_leaf = {(r["source"], r["lang"]): r["n"] for r in sizes.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).collect()}
    rows = []
    for leaf in leaves(root):
        n = per_leaf.get(leaf.key, 0)
        epochs = int(leaf.given // n) if n else 0
        if n:
            rows.append((*leaf.key, epochs, int(leaf.given - epochs * n)))
    plan = F.broadcast(spark.createDataFrame(rows, "source string, lang string, epochs int, border long"))  # one row per leaf
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("rid"))
    placed = sizes.join(plan, ["source", "lang"]).withColumn("h", order).withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(BUCKETS)).cast("int"))
    sums = placed.groupBy("source", "lang", "bucket").agg(F.sum("n_tokens").alias("s"))
    upto = Window.partitionBy("source", "lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    begin = sums.withColumn("begin", F.coalesce(F.sum("s").over(upto), F.lit(0)))
    joined = placed.join(begin, ["source", "lang", "bucket"])
    whole = joined.where("begin + s <= border").withColumn("extra", F.lit(1))
    beyond = joined.where("begin >= border and begin + s > border").withColumn("extra", F.lit(0))
    inside = Window.partitionBy("source", "lang", "bucket").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = joined.where("begin < border and begin + s > border")
    cut = cut.withColumn("upto", F.col("begin") + F.sum("n_tokens").over(inside)).withColumn("extra", (F.col("upto") <= F.col("border")).cast("int")).drop("upto")
    every = whole.unionByName(beyond).unionByName(cut)
    return every.select("rid", "source", "lang", "n_tokens", (F.col("epochs") + F.col("extra")).alias("uses")).where("uses > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, used_tokens, actual_share) of a mix, one row per target."""
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"))
    all_ = Window.partitionBy(F.lit(0))  # one row per target
    return (
        targets.select("source", "target_share").join(used, "source", "left").na.fill(0, ["used_tokens"])
        .withColumn("actual_share", F.round(F.try_divide("used_tokens", F.sum("used_tokens").over(all_)), 6))
    )
