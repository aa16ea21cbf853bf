"""Message templates: mining with a fixed-depth tree or by longest common subsequence, assignment, decoding."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.functions.text import WILDCARD
from strandline.operators import replay
from strandline.operators.sequences import required
from strandline.plans.lookup import lookup_join
from strandline.plans.running import numbered, ranged
from strandline.session import written


class FixedDepthTree:
    """Clusters of equally long messages, routed by length and by a few leading tokens."""

    def __init__(self, depth: int = 4, similarity: float = 0.4, max_children: int = 100):
        self.levels = max(depth - 3, 0)
        self.shortest = max(depth - 2, 1)
        self.similarity, self.max_children = similarity, max_children
        self.roots: dict[int, dict] = {}
        self.leaves: dict[int, list[int]] = {}
        self.template: dict[int, list[str]] = {}
        self.versions: dict[int, int] = {}

    def ignores(self, message: list[str]) -> bool:
        return len(message) < self.shortest

    def version(self, message: list[str]) -> int:
        return self.versions.get(len(message), 0)

    def decide(self, message: list[str]) -> tuple[int | None, list[str] | None]:
        node = self.roots.get(len(message))
        for token in message[: self.levels]:
            if node is None:
                break
            node = node.get(token, node.get(WILDCARD))
        if node is None:
            return None, None
        best, place = None, (-1.0, -1)
        for cluster in self.leaves.get(id(node), []):
            template = self.template[cluster]
            equal = sum(t == m for t, m in zip(template, message) if t != WILDCARD)
            here = (equal / len(message), template.count(WILDCARD))
            if here > place:
                best, place = cluster, here
        if best is None or place[0] < self.similarity:
            return None, None
        template = self.template[best]
        merged = [t if t == m else WILDCARD for t, m in zip(template, message)]
        return best, (merged if merged != template else None)

    def learn(self, cluster: int, template: list[str]) -> None:
        length = len(template)
        self.versions[length] = self.versions.get(length, 0) + 1
        if cluster not in self.template:
            node = self.roots.setdefault(length, {})
            for token in template[: self.levels]:
                node = node.setdefault(self._branch(node, token), {})
            self.leaves.setdefault(id(node), []).append(cluster)
        self.template[cluster] = template

    def _branch(self, node: dict, token: str) -> str:
        """Branch a new cluster takes: its token while there is room, the wildcard for digits and overflow."""
        if token in node:
            return token
        if any(c.isdigit() for c in token):
            return WILDCARD
        reserved = 0 if WILDCARD in node else 1
        return token if len(node) + reserved < self.max_children else WILDCARD


class ConstantPaths:
    """Constant parts of the templates as paths from a root; a path's end names the first cluster that had it.

    A step is shared by all templates that begin with it and goes when the last of them is taken out.
    """

    def __init__(self) -> None:
        self.step: dict[tuple[int, str], int] = {}
        self.users: dict[int, int] = {}
        self.owner: dict[int, int] = {}
        self.last = 0

    def add(self, constants: list[str], cluster: int) -> None:
        at = 0
        for token in constants:
            known = self.step.get((at, token))
            if known is None:
                self.last += 1
                known = self.step[at, token] = self.last
            self.users[known] = self.users.get(known, 0) + 1
            at = known
        self.owner.setdefault(at, cluster)

    def take_out(self, constants: list[str]) -> None:
        at = 0
        for token in constants:
            known = self.step.get((at, token))
            if known is None:
                return
            if self.users[known] == 1:
                del self.step[at, token]  # all below it is out of reach as well
                return
            self.users[known] -= 1
            at = known

    def find(self, message: list[str], enough) -> int | None:
        """Follow the message's tokens that continue a path, skipping those that do not, to an end that is ``enough``."""
        at = 0
        for token in message:
            known = self.step.get((at, token))
            if known is None:
                continue
            cluster = self.owner.get(known)
            if cluster is None:
                at = known
            elif enough(cluster):
                return cluster
        return None


class CommonSubsequence:
    """Clusters of phrase lists that share a long common subsequence."""

    def __init__(self, tau: float = 0.5):
        self.tau = tau
        self.paths = ConstantPaths()
        self.template: dict[int, list[str]] = {}
        self.sets: dict[int, set[str]] = {}
        self.changes = 0

    def ignores(self, message: list[str]) -> bool:
        return not message

    def version(self, message: list[str]) -> int:
        return self.changes

    def decide(self, message: list[str]) -> tuple[int | None, list[str] | None]:
        constants = _constants(message)
        found = self.paths.find(constants, lambda c: len(_constants(self.template[c])) >= self.tau * len(constants))
        if found is not None:
            return found, None
        present = set(constants) | {WILDCARD}
        for cluster, template in self.template.items():
            if len(template) >= 0.5 * len(constants) and self.sets[cluster] <= present:
                return cluster, None
        seen, best, best_common = set(message), None, None
        for cluster, template in self.template.items():
            if len(seen & self.sets[cluster]) < 0.5 * len(message):
                continue
            common = longest_common(message, template)
            if best is None or (len(common), -len(template)) > (len(best_common), -len(self.template[best])):
                best, best_common = cluster, common
        if best is None or len(best_common) < self.tau * len(message):
            return None, None
        template = self.template[best]
        merged = with_gaps(best_common, template)
        return best, (merged if merged != template else None)

    def learn(self, cluster: int, template: list[str]) -> None:
        self.changes += 1
        if cluster in self.template:
            self.paths.take_out(_constants(self.template[cluster]))
        self.template[cluster] = template
        self.sets[cluster] = set(template)
        self.paths.add(_constants(template), cluster)


def _constants(tokens: list[str]) -> list[str]:
    return [t for t in tokens if t != WILDCARD]


def longest_common(a: list[str], b: list[str]) -> list[str]:
    """Longest common subsequence; among equals the one reached by skipping ends of ``a`` first, then of ``b``."""
    size = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(size[-1][j] + 1 if x == y else max(row[j], size[-1][j + 1]))
        size.append(row)
    i, j, common = len(a), len(b), []
    while size[i][j]:
        if size[i - 1][j] == size[i][j]:
            i -= 1
        elif size[i][j - 1] == size[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            common.append(a[i])
    return common[::-1]


def with_gaps(common: list[str], template: list[str]) -> list[str]:
    """Template with everything outside the common part as wildcards; one wildcard stands for the rest of the end."""
    out: list[str] = []
    left = iter(common)
    wanted = next(left, None)
    for token in template:
        if wanted is None:
            return [*out, WILDCARD]
        if token == wanted:
            out.append(token)
            wanted = next(left, None)
        else:
            out.append(WILDCARD)
    return out


def _mine(lines: DataFrame, content: str, split: Column, make, joiner: str, first_lines: int) -> DataFrame:
    # Every round reads the messages, so they are masked once; few distinct texts make a small table.
    messages = written(lines.select("line_id", F.array_join(split, replay.SEPARATOR).alias("message")))
    changes = replay.learn_templates(messages, make, first_lines)
    spark = lines.sparkSession
    finals = [(c, t.replace(replay.SEPARATOR, joiner)) for c, t in replay.final_templates(changes).items()]
    names = spark.createDataFrame(finals, "cluster long, template string")
    placed = lookup_join(replay.assign_templates(messages, make, changes), names, ["cluster"], "inner", F.col("line_id"))
    structured = lines.join(placed.select("line_id", "template"), "line_id", "left").withColumn(
        "EventTemplate", F.coalesce("template", F.array_join(split, joiner))
    ).drop("template")
    return structured.withColumn("EventId", text.event_id(F.col("EventTemplate")))


def mine_fixed_depth(
    lines: DataFrame, content: str, rules: list[str], depth: int = 4, similarity: float = 0.4, max_children: int = 100,
    first_lines: int = replay.FIRST_LINES,
) -> DataFrame:
    """Add ``EventTemplate`` and ``EventId`` as a sequential fixed-depth-tree parse of the log assigns them.

    ``lines`` has a dense ``line_id`` and the text column ``content``.
    """
    split = text.tokens(text.mask(F.col(content), rules))
    return _mine(lines, content, split, partial(FixedDepthTree, depth, similarity, max_children), " ", first_lines)


def mine_common_subsequence(
    lines: DataFrame, content: str, rules: list[str], tau: float = 0.5, first_lines: int = replay.FIRST_LINES
) -> DataFrame:
    """Add ``EventTemplate`` and ``EventId`` as a sequential longest-common-subsequence parse assigns them."""
    split = text.phrases(text.mask(F.col(content), rules))
    return _mine(lines, content, split, partial(CommonSubsequence, tau), " ", first_lines)


def template_table(structured: DataFrame) -> DataFrame:
    """``EventId, EventTemplate, Occurrences``."""
    return structured.groupBy("EventId", "EventTemplate").agg(F.count(F.lit(1)).alias("Occurrences"))


def numbered_templates(templates: DataFrame) -> DataFrame:
    """Templates numbered 1..n, most frequent first, ties by id."""
    falling = ranged(templates.withColumn("_less", -F.col("Occurrences")), ["_less", "EventId"])
    return numbered(falling, ["_less", "EventId"], F.col("_range"), "number").drop("_less", "_range")


def merge_by_position(messages: DataFrame, group: list[str], tokens: str) -> DataFrame:
    """One template per group of equally long messages: a token where all agree, the wildcard elsewhere."""
    opened = messages.select(*group, F.posexplode(tokens).alias("pos", "token"))
    agreed = opened.groupBy(*group, "pos").agg(F.min("token").alias("_a"), F.max("token").alias("_b"))
    kept = agreed.select(*group, "pos", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(WILDCARD).alias("token"))
    return kept.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).getField("token").alias("template"))


def rarest_constants(templates: DataFrame) -> DataFrame:
    """``_n, _p, _k, template``: every distinct template under its length and its rarest constant, the position and token that the fewest
    templates of its length have; under position -1 where it has none. Adds ``_wild``, its number of wildcards."""
    each = written(templates.select("template").distinct().withColumn("_n", F.size("template")))
    opened = each.select("_n", "template", F.posexplode("template").alias("_p", "_k")).where(F.col("_k") != WILDCARD)
    shared = opened.groupBy("_n", "_p", "_k").agg(F.count(F.lit(1)).alias("_held"))
    rarest = opened.join(shared, ["_n", "_p", "_k"]).groupBy("template").agg(F.min(F.struct("_held", "_p", "_k")).alias("_r"))
    wild = F.size(F.filter("template", lambda t: t == WILDCARD))
    return each.join(rarest, "template", "left").select(
        "_n", F.coalesce("_r._p", F.lit(-1)).alias("_p"), F.coalesce("_r._k", F.lit("")).alias("_k"), "template", wild.alias("_wild")
    )


def assign_known(messages: DataFrame, templates: DataFrame, tokens: str) -> DataFrame:
    """Best known template of every message: equally long, all constants equal, most equal tokens, then the last by its tokens.

    An inverted index leads from ``(length, position, constant)`` to the templates whose rarest constant that is, so a message of ``n``
    tokens meets ``n + 1`` short lists and not all templates of its length. Distinct token lists are asked once.
    """
    distinct = messages.select(F.col(tokens).alias("_m")).where(F.col(tokens).isNotNull()).distinct()
    keys = F.concat(
        F.array(F.struct(F.lit(-1).alias("_p"), F.lit("").alias("_k"))), F.transform("_m", lambda t, i: F.struct(i.alias("_p"), t.alias("_k")))
    )
    asked = distinct.select("_m", F.size("_m").alias("_n"), F.explode(keys).alias("_e")).select("_m", "_n", "_e._p", "_e._k")
    met = lookup_join(asked, rarest_constants(templates), ["_n", "_p", "_k"], "inner", F.xxhash64("_m"))
    covering = met.where(F.forall(F.zip_with("template", "_m", lambda t, m: (t == WILDCARD) | (t == m)), lambda same: same))
    found = F.struct((F.col("_n") - F.col("_wild")).alias("equal"), F.col("_wild").alias("wild"), F.col("template").alias("template"))
    best = covering.groupBy("_m").agg(F.max(found).alias("_best"))
    return messages.join(best, F.col(tokens) == F.col("_m"), "left").select(
        *messages.columns, F.col("_best.template").alias("template"), F.col("_best.equal").alias("equal"), F.col("_best.wild").alias("wild")
    )


def decode_templates(elements: DataFrame, templates: DataFrame) -> DataFrame:
    """Replace event ids by their templates; an unknown id is an error."""
    known = templates.select("EventId", F.col("EventTemplate").alias("_known"))
    found = lookup_join(elements, known, ["EventId"], "left", F.col("pos"))
    return found.withColumn("EventTemplate", required(F.col("_known"), "template", F.col("EventId"))).drop("_known")


def decode_lines(elements: DataFrame, lines: DataFrame) -> DataFrame:
    """Replace line ids by the raw content of their lines."""
    return elements.join(lines, "line_id", "left")


