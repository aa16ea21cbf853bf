"""Registered queries and the SQL fragments their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries with optional oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(build: Query) -> Query:
            self.queries[name] = build
            if sql is not None:
                self.oracle[name] = sql
            return build

        return add


EVENT_LINES = """
event_lines as (
  select event_id + 1 as line_id, cast(floor(epoch(ts)) as bigint) as epoch, cast(user_id as varchar) as session,
         event_type || '_' || regexp_extract(props, '"k": ([0-9]+)', 1) as key,
         case when event_type = 'error' and cast(regexp_extract(props, '"k": ([0-9]+)', 1) as int) >= 97
              then 1 else 0 end as el_label, value
  from events)"""

SESSIONS = EVENT_LINES + """,
el as (
  select session as seq_id, row_number() over (partition by session order by line_id) - 1 as pos,
         line_id, key, el_label, epoch from event_lines),
seqs as (select seq_id, count(*) as n, cast(max(el_label) as bigint) as label from el group by 1)"""

SPLIT = SESSIONS + """,
parts as (
  select seq_id, label,
         case when label = 0 then case when rn <= floor(tot * 0.8::double) then 'train' else 'test_normal' end
              else case when rn <= floor(tot * 0.5::double) then 'test_abnormal' else 'valid_abnormal' end end as part
  from (select seq_id, label, count(*) over (partition by label) as tot,
               row_number() over (partition by label
                 order by md5(case when label = 0 then '42' else '12' end || '|' || seq_id), seq_id) as rn
        from seqs)),
cnts as (select e.seq_id, e.key, count(*) as cnt, p.part, p.label
         from el e join parts p using (seq_id) group by 1, 2, 4, 5),
known as (select distinct key from cnts where part = 'train')"""

WINDOW_SECONDS, STEP_SECONDS = 21600, 7200

WINDOWS = EVENT_LINES + f""",
clocked as (select *, max(epoch) over (order by line_id) as r from event_lines),
bounds as (select min(r) as t0, max(r) as tm from clocked),
ks as (select unnest(generate_series(0, cast(greatest(0, floor((tm - t0 - {WINDOW_SECONDS}) / {STEP_SECONDS}.0) + 1) as bigint))) as k, t0
       from bounds),
raw_windows as (
  select k, min(line_id) as first_line, max(line_id) as last_line, count(*) as n, cast(max(el_label) as bigint) as label
  from ks join clocked on r >= t0 + k * {STEP_SECONDS} and r < t0 + k * {STEP_SECONDS} + {WINDOW_SECONDS} group by k),
windows as (
  select min(k) as seq_id, first_line, last_line, any_value(n) as n, any_value(label) as label
  from raw_windows group by first_line, last_line),
wel as (
  select w.seq_id, l.line_id - w.first_line as pos, l.line_id, l.key, l.el_label, w.label
  from windows w join clocked l on l.line_id between w.first_line and w.last_line
  where w.n >= 10 and l.line_id - w.first_line < 512)"""

ORDERS = """
ol as (
  select l_orderkey as seq_id, cast(floor(epoch(l_shipdate)) as bigint) as epoch, l_linenumber as line_number,
         l_returnflag || l_linestatus || cast(cast(floor(l_quantity / 10) as int) as varchar) as key from lineitem),
oel as (
  select seq_id, key, epoch, row_number() over (partition by seq_id order by epoch, line_number, key) - 1 as pos from ol)"""
