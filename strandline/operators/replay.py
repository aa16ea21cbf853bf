"""Exact parallel runs of learners that read a log line by line.

Template miners are sequential: a line either fits what was learned before it, or changes it. Nearly all lines change
nothing, and those need only the state as it was at their position. The run therefore keeps the short list of lines
that may change the state:

1. every task walks its own lines in order, starting from the known changes, and reports lines that would change more;
2. the reported lines are replayed in log order, which gives the list of changes with their positions;
3. all lines are checked again against that list, in parallel, until no task reports a line.

At that point every line either is in the list or leaves the state alone, so the list is what a sequential run over
the whole log produces. The list grows with the number of templates, not with the log; its size is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
FIRST_LINES = 1 << 18
GROWTH = 16
REPORTS_PER_ROUND = 50_000
MAX_CHANGES = 2_000_000

Change = tuple[int, int, str]


class Learner(Protocol):
    """State of a miner. Templates and messages are token lists."""

    def decide(self, message: list[str]) -> tuple[int | None, list[str] | None]:
        """Cluster of the message (``None``: a new one) and its template if that changes (``None``: it stays)."""

    def learn(self, cluster: int, template: list[str]) -> None:
        """Add a cluster or replace its template."""

    def ignores(self, message: list[str]) -> bool:
        """Messages that are never learned keep their own text as template."""

    def version(self, message: list[str]) -> int:
        """Changes whenever the decision on this message may change."""


def _walk(
    batches: Iterator[pd.DataFrame], make: Callable[[], Learner], changes: list[Change], report: bool
) -> Iterator[pd.DataFrame]:
    learner, at, memo = make(), 0, {}
    for batch in batches:
        out: list[tuple] = []
        for line, text in zip(batch["line_id"].to_list(), batch["message"].to_list()):
            while at < len(changes) and changes[at][0] < line:
                learner.learn(changes[at][1], changes[at][2].split(SEPARATOR))
                at += 1
            if at < len(changes) and changes[at][0] == line:
                learner.learn(changes[at][1], changes[at][2].split(SEPARATOR))
                if not report:
                    out.append((line, changes[at][1]))
                at += 1
                continue
            message = text.split(SEPARATOR) if text else []
            if learner.ignores(message):
                continue
            version = learner.version(message)
            known = memo.get(text)
            if known is None or known[0] != version:
                known = (version, learner.decide(message))
                memo[text] = known
            cluster, template = known[1]
            if cluster is None or template is not None:
                if report:
                    out.append((line, text))
                learner.learn(line if cluster is None else cluster, message if cluster is None else template)
            elif not report:
                out.append((line, cluster))
        if len(memo) > 200_000:
            memo.clear()
        yield pd.DataFrame(out, columns=["line_id", "message" if report else "cluster"])


def _replay(lines: dict[int, str], make: Callable[[], Learner]) -> list[Change]:
    """The changes the candidate lines cause when read in log order."""
    learner, changes = make(), []
    for line in sorted(lines):
        message = lines[line].split(SEPARATOR)
        cluster, template = learner.decide(message)
        if cluster is None or template is not None:
            cluster, template = (line, message) if cluster is None else (cluster, template)
            learner.learn(cluster, template)
            changes.append((line, cluster, SEPARATOR.join(template)))
    return changes


def learn_templates(
    messages: DataFrame, make: Callable[[], Learner], first_lines: int = FIRST_LINES, growth: int = GROWTH
) -> list[Change]:
    """All changes of a sequential run over ``line_id, message`` (tokens joined by ``SEPARATOR``).

    The log is taken in growing heads: most templates appear early, and the tasks of the long last rounds then start
    from a nearly complete list.
    """
    last = messages.agg(F.max("line_id")).first()[0] or 0
    candidates: dict[int, str] = {}
    changes: list[Change] = []
    reach = min(first_lines, last)
    while reach:
        head = messages.filter(F.col("line_id") <= reach).sortWithinPartitions("line_id")
        while True:
            known = changes
            reported = head.mapInPandas(
                lambda it, known=known: _walk(it, make, known, True), "line_id long, message string"
            )
            # A message is reported by many tasks; its first line is enough, later ones are checked again.
            first = reported.groupBy("message").agg(F.min("line_id").alias("line_id"))
            found = {r["line_id"]: r["message"] for r in first.orderBy("line_id").limit(REPORTS_PER_ROUND).collect()}
            if not found:
                break
            candidates.update(found)
            changes = _replay(candidates, make)
            if len(candidates) > MAX_CHANGES:
                raise ValueError("the messages do not settle into templates; mask their variable parts first")
        if reach == last:
            return changes
        reach = min(last, reach * growth)
    return changes


def assign_templates(messages: DataFrame, make: Callable[[], Learner], changes: list[Change]) -> DataFrame:
    """``line_id, cluster`` of every learned line; the cluster is named after the line that opened it."""
    return messages.sortWithinPartitions("line_id").mapInPandas(
        lambda it: _walk(it, make, changes, False), "line_id long, cluster long"
    )


def final_templates(changes: list[Change]) -> dict[int, str]:
    """Template of every cluster after the last line."""
    return {cluster: template for _, cluster, template in changes}
