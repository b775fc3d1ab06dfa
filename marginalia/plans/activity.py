"""Queries of reader activity over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as A
from .base import Queries

Q = Queries()
AS_OF = "2024-01-10 00:00:00"
ROWS = """with act as (select event_id, 'user' || user_id as "user", 'Doc ' || regexp_extract(props, '"k":\\s*(\\d+)', 1) as path, event_type as action, ts, value as amount from events),
prog as (select "user", path, max(ts) as last_read, least(arg_max(amount, (ts, event_id)), 100.0) as percent, round(sum(amount), 4) as duration from act group by all),
shares as (select 's' || event_id as token, path, "user" as creator, ts as created_at, case when event_id % 20 = 0 then ts + interval 3 day end as expires_at, case when event_id % 30 = 0 then (event_id % 7)::int end as max_visits, (event_id % 9)::int as visit_count from act where event_id % 10 = 0),
told as (select *, not (coalesce(timestamp '""" + AS_OF + """' > expires_at, false) or coalesce(visit_count >= max_visits, false)) as valid from shares) """


def on(name, run, sql):
    Q.plain(name, lambda spark, sf_dir: run(A.activity(spark, sf_dir)), sql and ROWS + sql)


on("progress_upsert", A.progress, 'select *, percent >= 95 as completed from prog')
on("user_progress", lambda r: A.user_progress(A.progress(r), "user7"), """select *, percent >= 95 as completed from prog where "user" = 'user7' order by last_read desc, path limit 20""")
on("user_history", lambda r: A.user_history(r, "user7"), """select "user", path, ts, amount from act where "user" = 'user7' order by ts desc, event_id desc limit 50""")
on("keep_last_n", lambda r: A.keep_last_n(r, 5).select("event_id"), 'select event_id from act qualify row_number() over (partition by "user" order by ts desc, event_id desc) <= 5')
on("visit_counts", A.visit_counts, 'select path, count(*) as visits, min("user") as first_user from act group by path order by visits desc, path limit 10')
on("recent_distinct", lambda r: A.recent_distinct(r, 3), 'select "user", path, ts, row_number() over (partition by "user" order by ts desc, path)::int as place from (select "user", path, max(ts) as ts from act group by all) qualify place <= 3')
on("favorites", lambda r: A.favorites(r.withColumn("op", F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add"))), """select "user", path from act group by all having arg_max(event_id % 3, (ts, event_id)) <> 0""")
on("delete_progress", lambda r: A.delete_keys(A.progress(r), r.where("event_id % 4 = 0"), ["user", "path"]).select("user", "path", "duration"), 'select "user", path, duration from prog where ("user", path) not in (select ("user", path) from act where event_id % 4 = 0)')
on("clear_history", lambda r: A.delete_keys(r.where("action = 'click'"), r.where("event_id % 100 = 0"), ["user"]).select("event_id"), """select event_id from act where action = 'click' and "user" not in (select "user" from act where event_id % 100 = 0)""")
on("share_status", lambda r: A.share_status(A.shares(r), AS_OF).select("token", "valid"), "select token, valid from told")
on("share_visits", lambda r: A.share_visits(A.shares(r), r), "select token, least(count(event_id), coalesce(max_visits, count(event_id)))::bigint as visits from shares s left join (select path, ts, event_id from act) a on a.path = s.path and a.ts >= s.created_at and (expires_at is null or a.ts <= expires_at) group by token, max_visits")
on("shares_by_user", lambda r: A.shares_by(A.shares(r), "creator", "user7").select("token", "path"), "select token, path from shares where creator = 'user7'")
on("shares_by_note", lambda r: A.shares_by(A.shares(r), "path", "Doc 7").select("token", "creator"), "select token, creator from shares where path = 'Doc 7'")
on("all_shares", lambda r: A.shares(r).select("token", "path", "creator", F.coalesce("max_visits", F.lit(-1)).alias("max_visits")), "select token, path, creator, coalesce(max_visits, -1) as max_visits from shares")
on("shares_cleanup", lambda r: A.shares_cleanup(A.shares(r), AS_OF)[1], "select count(*) filter (where not valid) as removed from told")
on("sync_runs_last", lambda r: A.runs_last(r, 10).select("event_id", "ts"), "select event_id, ts from act order by ts desc, event_id desc limit 10")
on("duration_histogram", lambda r: A.duration_histogram(r, [1, 5, 10, 50, 100]), "select le::double as le, (select count(*) from act where amount <= le) as n, (select count(*) from act) as total, (select round(sum(amount), 2) from act) as amount from (values (1.0), (5.0), (10.0), (50.0), (100.0)) v(le)")
on("op_counters", A.op_counters, "select action, count(*) as n from act group by action")
on("user_directory", A.user_directory, """select "user", case when substr("user", 5)::int % 10 = 0 then 'admin' else 'reader' end as role, substr("user", 5)::int % 13 <> 0 as enabled, max(ts) as last_seen, count(*) as n_actions from act group by 1""")
