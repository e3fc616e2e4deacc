"""Queries over profiles, units, ledgers, caches, tables and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions import geometry as G
from sparkfolio.functions import text as X
from sparkfolio.operators import layout as Y
from sparkfolio.operators import profile as P
from sparkfolio.operators import tables as B
from sparkfolio.operators import units as U
from sparkfolio.plans.layout_queries import blocks
from sparkfolio.plans.registry import query, table
from sparkfolio.plans.text_queries import locked_sql
from sparkfolio.sources.files import html_blocks as parsed_html
from sparkfolio.sources.lines import LINES_SQL

PAGES_SQL = LINES_SQL + """, pages as (
  select doc_id, page_idx, case when page_idx % 3 = 2 then 0 else sum(length(text)) end::bigint as text_chars,
    ((doc_id + page_idx) % 10)::double / 10 as image_coverage from lines group by doc_id, page_idx
)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = blocks(spark, sf_dir).groupBy("doc_id", "page_idx").agg(F.sum(F.length("text")).alias("c"))
    chars = F.when(F.col("page_idx") % 3 == 2, 0).otherwise(F.col("c"))
    return n.select("doc_id", "page_idx", chars.alias("text_chars"), ((F.col("doc_id") + F.col("page_idx")) % 10 / 10).alias("image_coverage"))


@query(f"""with {PAGES_SQL}, f as (select *, text_chars > 0 as t, image_coverage >= 0.45 as i from pages),
a as (select doc_id, count(*) as pages, count_if(t)::bigint as native_text_pages, count_if(i)::bigint as scan_pages, count_if(t and i)::bigint as searchable_scan_pages, round(avg(image_coverage), 4) as average_image_coverage from f group by doc_id),
k as (select *, case when scan_pages > 0 and 2 * scan_pages >= pages and searchable_scan_pages = scan_pages then 'searchable_scan' when scan_pages > 0 and 2 * scan_pages >= pages then 'image_scan' when native_text_pages > 0 then 'born_digital' else 'unknown' end as kind from a)
select *, case when kind = 'born_digital' then 'direct' else 'recognize' end as route from k""")
def doc_profile_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.document_profile(_pages(spark, sf_dir))


@query(f"""with {PAGES_SQL} select doc_id, page_idx, text_chars, image_coverage, text_chars > 0 as has_text, image_coverage >= 0.45 as is_image,
  case when text_chars > 0 and image_coverage >= 0.45 then 'searchable_scan' when image_coverage >= 0.45 then 'image' when text_chars > 0 then 'native' else 'blank' end as classification from pages""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_signals(_pages(spark, sf_dir))


QUALITY_SQL = LINES_SQL + """, boxes as (
  select doc_id, page_idx, n, case when page_idx % 2 = 0 then x1 - x0 else y1 - y0 end as w, case when page_idx % 2 = 0 then y1 - y0 else x1 - x0 end as h, ((n * 37) % 100)::double / 100 as confidence from lines
), q as (
  select doc_id, page_idx, count(*) as boxes, median(confidence) as mid, avg((h >= 1.25 * w)::int::double) as v, avg((w >= 1.25 * h)::int::double) as o from boxes group by all
)"""


@query(f"""with {QUALITY_SQL} select doc_id, page_idx, boxes, round(mid, 4) as median_confidence, round(v, 4) as vertical_ratio, round(o, 4) as horizontal_ratio,
  round(0.75 * mid + 0.25 * o, 4) as score, boxes >= 6 and v >= 0.55 and (mid < 0.8 or o < 0.35) as suspicious from q""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    turned = F.when(F.col("page_idx") % 2 == 0, b).otherwise(G.box(b["y0"], b["x0"], b["y1"], b["x1"]))
    boxes = blocks(spark, sf_dir).select("doc_id", "page_idx", turned.alias("bbox"), ((F.col("n") * 37) % 100 / 100).alias("confidence"))
    return P.page_quality(boxes)


@query("""with a as (select o_orderkey // 4 as doc_id, (o_orderkey % 4)::int as page_idx, unnest([0, 90, 270])::int as angle, o_custkey from orders),
s as (select doc_id, page_idx, angle, ((o_custkey * (angle + 7)) % 10)::double as score, (o_custkey + angle) % 3 = 0 as suspicious from a),
t as (select *, bool_or(angle = 0 and suspicious) over (partition by doc_id, page_idx) as turn from s)
select doc_id, page_idx, angle, score, suspicious as failed from t where angle = 0 or turn qualify row_number() over (partition by doc_id, page_idx order by score desc, angle) = 1""")
def best_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 4).alias("doc_id"), (F.col("o_orderkey") % 4).cast("int").alias("page_idx"), "o_custkey", F.explode(F.array(F.lit(0), F.lit(90), F.lit(270))).alias("angle"))
    tried = o.select("doc_id", "page_idx", "angle", ((F.col("o_custkey") * (F.col("angle") + 7)) % 10).cast("double").alias("score"), ((F.col("o_custkey") + F.col("angle")) % 3 == 0).alias("suspicious"))
    return P.best_orientation(tried)


@query("""with t as (select conv_id as doc_id, turn as page_idx, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') as e from conversations),
p as (select doc_id, page_idx, length(e)::bigint as expected, case page_idx % 4 when 1 then floor(length(e) * 0.6) else length(e) end as matched,
  case page_idx % 4 when 1 then floor(length(e) * 0.6) when 2 then 2 * length(e) else length(e) end as extracted from t)
select doc_id, round(sum(matched) / sum(expected), 6) as coverage, round(sum(extracted) / sum(expected), 6) as duplication, count_if(matched / expected < 0.78)::bigint as thin_pages,
  count_if(extracted / expected > 1.25)::bigint as doubled_pages, count_if(expected = 0 and extracted > 0)::bigint as stray_pages,
  count_if(matched / expected < 0.78) = 0 and count_if(extracted / expected > 1.25) = 0 and count_if(expected = 0 and extracted > 0) = 0 as passed from p group by doc_id having sum(expected) > 0""")
def layer_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, against layers that have them whole, cut off, twice, or with other spaces and marks."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_idx"), "text")
    k, n, key = F.col("page_idx") % 4, F.length(X.compact(F.col("text"))), X.compact(F.col("text"))
    layer = F.when(k == 1, F.substring(key, F.lit(1), F.floor(n * 0.6).cast("int"))).when(k == 2, F.concat("text", "text")).when(k == 3, F.regexp_replace("text", " ", " .  ")).otherwise(F.col("text"))
    return P.layer_verification(P.layer_matches(c, c.withColumn("text", layer)))


@query("""with s as (select p_partkey // 10 as doc_id, (p_partkey % 10)::int as page_idx, 600.0::double as width, 800.0::double as height, p_partkey, p_size from part),
o as (select doc_id, page_idx, case when p_partkey % 7 = 0 then 600.2 else 600.05 end::double as width, height from s where p_size > 5 union all select doc_id, 10, 600, 800 from s where page_idx = 1)
select coalesce(s.doc_id, o.doc_id) as doc_id, coalesce(s.page_idx, o.page_idx) as page_idx, case when o.width is null then 'missing' when s.width is null then 'extra' when abs(s.width - o.width) > 0.1 then 'size' end as fault
from s full join o on s.doc_id = o.doc_id and s.page_idx = o.page_idx where o.width is null or s.width is null or abs(s.width - o.width) > 0.1""")
def page_size_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("doc_id"), (F.col("p_partkey") % 10).cast("int").alias("page_idx"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), "p_partkey", "p_size")
    o = s.where("p_size > 5").withColumn("width", F.when(F.col("p_partkey") % 7 == 0, 600.2).otherwise(600.05)).drop("p_partkey", "p_size")
    extra = s.where("page_idx = 1").select("doc_id", F.lit(10).alias("page_idx"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return P.size_faults(s.drop("p_partkey", "p_size"), o.unionByName(extra))


@query("""with s as (select distinct n_nationkey as doc_id, p::int as page_idx, 500.0::double as width, n_regionkey as r from nation, range(3) t(p)),
b as (select doc_id, page_idx, case when r = 0 then 1000.0 else 500.0 end as width from s union all select doc_id, page_idx + 3, 500.0 from s where r = 1),
n as (select doc_id, count(*) as n, max(width) as w from b group by 1), m as (select doc_id, count(*) as m, max(width) as sw from s group by 1),
k as (select n.doc_id, m, case when n = m and w >= 1.8 * sw then 'side_by_side' when n = 2 * m and abs(w - sw) <= 2 then 'interleaved' end as mode from n join m using (doc_id))
select doc_id, mode, i::int as logical_idx, case when mode = 'side_by_side' then i else 2 * i + 1 end::int as physical_idx, case when mode = 'side_by_side' then 0.5 else 0.0 end::double as x_from from k, range(3) t(i) where mode is not null""")
def bilingual_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("page_idx"), F.lit(500.0).alias("width"), F.col("n_regionkey").alias("r"))
    b = s.withColumn("width", F.when(F.col("r") == 0, 1000.0).otherwise(500.0))
    return P.bilingual_map(b.unionByName(s.where("r = 1").withColumn("page_idx", F.col("page_idx") + 3)), s)


@query("select conv_id, turn, role, text, lag(text) over w as previous, lead(text) over w as next from conversations window w as (partition by conv_id order by turn)")
def context_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_context(table(spark, sf_dir, "conversations"), order="turn", group="conv_id").select("conv_id", "turn", "role", "text", "previous", "next")


@query("""with u as (select conv_id as doc_id, turn as unit_id, case role when 'user' then 'body' when 'system' then 'heading' else 'cell' end as kind, (turn // 3)::int as page_idx, (turn % 2)::double as y, 0.0::double as x, text from conversations),
p as (select *, row_number() over (partition by doc_id order by page_idx, y, x, case kind when 'heading' then 0 when 'body' then 1 else 2 end, unit_id) - 1 as position from u)
select doc_id, unit_id, kind, position::int as position, lag(text) over w as previous, lead(text) over w as next from p window w as (partition by doc_id order by position)""")
def turn_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_id"), "role", F.floor(F.col("turn") / 3).cast("int").alias("page_idx"), (F.col("turn") % 2).cast("double").alias("y"), F.lit(0.0).alias("x"), "text")
    kinds = {"user": "body", "system": "heading", "assistant": "cell"}
    units = U.united(*[c.where(F.col("role") == r).withColumn("kind", F.lit(k)) for r, k in kinds.items()])
    return U.with_context(U.reading_order(units)).select("doc_id", "unit_id", "kind", "position", "previous", "next")


@query(f"""with {LINES_SQL} select doc_id, page_idx, (n // 5)::int as band, string_agg(text, ' ' order by y0, x0, text) as text from lines group by all""")
def paragraph_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = blocks(spark, sf_dir).select("doc_id", "page_idx", F.floor(F.col("n") / 5).cast("int").alias("band"), F.col("bbox.y0").alias("y"), F.col("bbox.x0").alias("x"), "text")
    return U.assembled(m, ["doc_id", "page_idx", "band"])


@query("""select min(doc_id) as doc_id, sha256(text) as fingerprint, count(*) as copies from documents group by text""")
def content_fingerprint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""select doc_id, sha256('dpi=600' || chr(31) || 'model=a' || chr(31) || sha256(text)) as fingerprint, case when bool_or(lang = 'en') over (partition by text) then 'old' else 'new' end as result,
  bool_or(lang = 'en') over (partition by text) as hit from documents""")
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", "lang", U.fingerprint(F.col("text"), model="a", dpi="600").alias("fingerprint"))
    held = F.when(F.bool_or(F.col("lang") == "en"), "old").alias("result")
    cache = asked.groupBy("fingerprint").agg(held)
    return U.cached(asked.drop("lang"), cache, lambda misses: misses.withColumn("result", F.lit("new")))


@query("""with p as (select o_custkey as doc_id, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as page_idx from orders),
i as (select *, case when page_idx % 3 = 1 then (doc_id % 4)::int else 0 end as extra from p),
s as (select *, coalesce(sum(extra + 1) over (partition by doc_id order by page_idx rows between unbounded preceding and 1 preceding), 0) as s from i)
select doc_id, page_idx, unnest(range(extra + 1))::int as part, (s + unnest(range(extra + 1)))::bigint as physical_idx from s""")
def page_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(w) - 1).alias("page_idx"))
    extra = F.when(F.col("page_idx") % 3 == 1, F.col("doc_id") % 4).otherwise(0).cast("int")
    inserted = pages.select("doc_id", "page_idx", extra.alias("extra"))
    return U.renumbered(pages, inserted)


@query("""with n as (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1), w as (select distinct l_orderkey from lineitem where l_linestatus = 'O')
select coalesce(n.l_orderkey, w.l_orderkey) as l_orderkey, case when n.n is null then 'lacking' when w.l_orderkey is null then 'foreign' else 'doubled' end as fault
from n full join w on n.l_orderkey = w.l_orderkey where n.n is null or w.l_orderkey is null or n.n > 1""")
def partition_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return U.partition_faults(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"), ["l_orderkey"])


@query("""select l_orderkey, 'left' as side from (select l_orderkey from lineitem where l_linenumber = 1 except all select o_orderkey from orders where o_orderstatus <> 'P') union all
select o_orderkey, 'right' from (select o_orderkey from orders where o_orderstatus <> 'P' except all select l_orderkey from lineitem where l_linenumber = 1)""")
def key_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey")
    return U.same_keys(a, table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")))


@query(f"""with w as (select doc_id, unnest(string_split(text, ' ')) as t from documents),
f as (select doc_id, t, {locked_sql("t")} as locked,
  regexp_matches(t, '[A-Za-z]') as wanted, len(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)?')) as k from w)
select doc_id, count(*) as units, count_if(wanted and not locked)::bigint as translated, count_if(not (wanted and not locked))::bigint as preserved, (count_if(locked) + coalesce(sum(case when not locked then k end), 0))::bigint as protected from f group by doc_id""")
def plan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("text"))
    return U.counters(words, ["doc_id"], "zh")


@query("""select conv_id as doc_id, (turn // 3 + 1)::int as page, (turn + 1)::int as "order", turn as unit_id, role as kind, text as source, 'T: ' || text as target, role <> 'system' as translated from conversations""")
def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 3).cast("int").alias("page_idx"), F.col("turn").cast("int").alias("position"), F.col("turn").alias("unit_id"),
        F.col("role").alias("kind"), F.col("text").alias("source"), F.concat(F.lit("T: "), "text").alias("target"), (F.col("role") != "system").alias("translated"),
    )
    nested = U.ledger(units)
    flat = nested.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page", F.explode("p.entries").alias("e"))
    return flat.select("doc_id", "page", "e.*")


@query("""with e as (select user_id as job, event_type as stage, ts from events)
select job, stage, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::bigint as ms from e group by all union all select job, 'total', ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000)::bigint from e group by job""")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.stage_timings(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts")))


@query("""select time_bucket(interval '6 hours', ts, timestamp '2000-01-01') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def progress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkfolio.streaming.progress import windowed

    return windowed(table(spark, sf_dir, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


SPEC_SQL = """e as (select o_orderkey // 20 as doc_id, 0::int as page_idx, case when o_orderkey % 11 = 0 then '' else 'e' || (o_orderkey % 19) end as element_id, case when o_orderkey % 13 = 0 then 'video' else 'text' end as type,
  (o_orderkey % 50)::double as x0, 10.0::double as y0, (o_orderkey % 70)::double as x1, 20.0::double as y1, 60.0::double as page_width, 100.0::double as page_height, case when o_orderkey % 9 = 0 then ' ' else 'x' end as text,
  (o_orderkey % 12)::double as font_size, 6.0::double as min_font_size, case when o_orderkey % 6 = 0 then 'middle' end as align, case when o_orderkey % 4 = 0 then '#12x456' end as color from orders)"""


@query(f"""with {SPEC_SQL}, r as (select doc_id, page_idx, element_id, unnest([case when trim(element_id) = '' then 'no_id' end, case when count(*) over (partition by doc_id, element_id) > 1 then 'doubled_id' end,
  case when type not in ('text', 'image', 'cover') then 'type' end, case when not (x1 > x0 and y1 > y0) then 'bbox' end, case when x1 > page_width + 0.5 then 'out_of_page' end, case when type = 'text' and trim(text) = '' then 'no_text' end,
  case when min_font_size > font_size then 'font_order' end, case when coalesce(align, 'left') not in ('left', 'center', 'right', 'justify') then 'align' end, case when color is not null then 'color' end]) as code from e)
select * from r where code is not null""")
def spec_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = lambda c: c.cast("double")
    e = table(spark, sf_dir, "orders").select(
        F.floor(k / 20).alias("doc_id"), F.lit(0).alias("page_idx"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("e"), (k % 19).cast("string"))).alias("element_id"), F.when(k % 13 == 0, "video").otherwise("text").alias("type"),
        d(k % 50).alias("x0"), F.lit(10.0).alias("y0"), d(k % 70).alias("x1"), F.lit(20.0).alias("y1"), F.lit(60.0).alias("page_width"), F.lit(100.0).alias("page_height"), F.when(k % 9 == 0, " ").otherwise("x").alias("text"),
        d(k % 12).alias("font_size"), F.lit(6.0).alias("min_font_size"), F.when(k % 6 == 0, "middle").alias("align"), F.when(k % 4 == 0, "#12x456").alias("color"),
    )
    return U.spec_issues(e)


@query("""with p as (select s_suppkey // 5 as doc_id, (s_suppkey % 5 - case when s_suppkey % 17 = 0 then 9 else 0 end)::int as page_idx, case when s_suppkey % 7 = 0 then 0 else 600 end::double as width, 800.0::double as height, (s_suppkey % 4 * 90 + case when s_suppkey % 13 = 0 then 1 else 0 end)::int as angle from supplier
  union all select s_suppkey // 5, 1, 600, 800, 0 from supplier where s_acctbal < 2000),
b as (select s_suppkey // 5 as doc_id, (s_suppkey % 6)::int as page_idx, s_suppkey::int as idx, 1.0 as x0, 1.0 as y0, case when s_suppkey % 3 = 0 then 0.5 else 2 end as x1, 2.0 as y1, case when s_suppkey % 5 = 0 then ' ' else 'x' end as text from supplier)
select doc_id, page_idx, null::int as idx, 'negative_page' as code from p where page_idx < 0
union all select doc_id, page_idx, null, 'doubled_page' from p group by all having count(*) > 1
union all select doc_id, page_idx, null, 'page_size' from p where not (width > 0 and height > 0)
union all select doc_id, page_idx, null, 'angle' from p where angle % 90 <> 0
union all select doc_id, page_idx, idx, 'bbox' from b where not (x1 > x0 and y1 > y0)
union all select doc_id, page_idx, idx, 'blank_text' from b where trim(text) = ''
union all select doc_id, page_idx, idx, 'no_page' from b where (doc_id, page_idx) not in (select (doc_id, page_idx) from p)""")
def layout_contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    doc = F.floor(k / 5).alias("doc_id")
    p = s.select(doc, (k % 5 - F.when(k % 17 == 0, 9).otherwise(0)).cast("int").alias("page_idx"), F.when(k % 7 == 0, 0.0).otherwise(600.0).alias("width"), F.lit(800.0).alias("height"), (k % 4 * 90 + F.when(k % 13 == 0, 1).otherwise(0)).cast("int").alias("angle"))
    more = s.where("s_acctbal < 2000").select(doc, F.lit(1).alias("page_idx"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0).alias("angle"))
    b = s.select(doc, (k % 6).cast("int").alias("page_idx"), k.cast("int").alias("idx"), F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"), F.when(k % 3 == 0, 0.5).otherwise(2.0).alias("x1"), F.lit(2.0).alias("y1"), F.when(k % 5 == 0, " ").otherwise("x").alias("text"))
    return U.layout_issues(p.unionByName(more), b)


@query("""with a as (select distinct l_orderkey as doc_id, l_linenumber as page_idx from lineitem where l_returnflag <> 'A'), b as (select distinct l_orderkey as doc_id, l_linenumber as page_idx from lineitem where l_linestatus = 'O')
select *, 'not_in_spec' as fault from (select * from a except select * from b) union all select *, 'not_in_source' from (select * from b except select * from a)""")
def spec_page_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    named = lambda df: df.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_idx"))
    return U.missing_pages(named(li.where("l_returnflag <> 'A'")), named(li.where("l_linestatus = 'O'")))


# Tables


@query("""with d as (select p_partkey // 6 as t, (p_partkey % 6)::int as "column", (1 + p_partkey % 17)::double as demand from part),
c as (select t, "column", floor(demand / sum(demand) over (partition by t) * 500 * 100)::bigint as cents, max("column") over (partition by t) as last from d)
select t, "column", case when "column" = last then 50000 - coalesce(sum(case when "column" < last then cents end) over (partition by t), 0) else cents end / 100.0::double as width from c""")
def width_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 6).alias("t"), (F.col("p_partkey") % 6).cast("int").alias("column"), (1 + F.col("p_partkey") % 17).cast("double").alias("demand"))
    return B.allocated_widths(d, ["t"], 500.0)


@query("""select l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice rows between unbounded preceding and 1 preceding), 0) as y from lineitem""")
def prefix_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    placed = li.select("*", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"))
    return B.running_offsets(placed, ["l_orderkey"], "at", "l_quantity", "y").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "y")


ROWS_SQL = """r as (select l_orderkey // 8 as t, (row_number() over (partition by l_orderkey // 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::int as row, l_partkey, l_quantity from lineitem),
s as (select t, row, row + case when l_partkey % 5 = 0 then 3 when l_partkey % 5 = 1 then 2 else 1 end as e from r),
g as (select *, coalesce(row >= max(e) over (partition by t order by row rows between unbounded preceding and 1 preceding), true) as fresh from s),
i as (select *, sum(fresh::int) over (partition by t order by row) as g from g)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("l_orderkey") / 8)
    w = Window.partitionBy(k).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    span = F.when(F.col("l_partkey") % 5 == 0, 3).when(F.col("l_partkey") % 5 == 1, 2).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(k.alias("t"), (F.row_number().over(w) - 1).alias("row"), (F.col("l_partkey") % 4).cast("int").alias("column"), span.alias("row_span"), (1 + F.col("l_partkey") % 3).cast("int").alias("lines"), F.repeat(F.lit("word "), (F.col("l_partkey") % 40).cast("int")).alias("text"), F.col("l_quantity").alias("quantity"))


@query(f"with {ROWS_SQL} select t, min(row)::int as first, max(row)::int as last from i group by t, g")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.atomic_groups(_cells(spark, sf_dir), ["t"])


@query("""with r as (select l_orderkey // 8 as t, (l_partkey % 4)::int as "column", repeat('word ', (l_partkey % 40)::int) as text from lineitem),
m as (select t, "column", max(list_max(list_transform(string_split_regex(text, '\\s+'), lambda x: length(x)))) * 4.5 as token, max(length(text)) * 4.5 as total, max(length(text)) as chars from r group by all)
select t, "column", least(190, greatest(token + 5, sqrt(total * 72) * least(3, greatest(1, chars / 80)), 34))::double as demand from m""")
def column_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.column_demand(_cells(spark, sf_dir), ["t"], F.lit(4.5))


@query("""with w as (select l_orderkey // 8 as t, l_orderkey as row, count(*) as width from lineitem group by all), n as (select t, width, count(*) as rows from w group by all)
select t, width as columns from n qualify row_number() over (partition by t order by rows desc, width desc) = 1""")
def consensus_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 8).alias("t"), "l_orderkey").agg(F.count("*").alias("w"))
    return B.consensus_columns(rows, ["t"], F.col("w"))


@query("""with v as (select l_orderkey // 40 as t, l_orderkey as row, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) * 60 + l_partkey % 9)::double as x from lineitem),
k as (select *, row_number() over (partition by t, row order by x) as c, count(*) over (partition by t, row) as n from v),
m as (select t, c, median(x) as anchor, count(*) as rows, list(x) as xs from k where n = 4 group by all),
g as (select *, anchor - lag(anchor) over (partition by t order by c) as gap, list_max(list_transform(xs, lambda x: abs(x - anchor))) as off from m),
f as (select t, c, anchor, rows, min(gap) over (partition by t) as least_gap, max(off) over (partition by t) as off from g)
select t, c::int as "column", anchor from f where rows >= 2 and least_gap >= 30 and off <= 0.38 * least_gap""")
def column_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    v = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 40).alias("t"), F.col("l_orderkey").alias("row"), (F.row_number().over(w) * 60 + F.col("l_partkey") % 9).cast("double").alias("x"))
    return B.column_anchors(v, ["t"], F.col("x"), 4, 600.0)


@query("""with v as (select l_orderkey, l_linenumber, l_quantity * 12 as x, row_number() over () as line from lineitem), a as (select unnest([0, 1, 2, 3])::int as c, unnest([100.0, 250.0, 400.0, 560.0])::double as anchor)
select l_orderkey, l_linenumber, x, arg_min(c, {'d': abs(x - anchor), 'c': c}) as "column" from v, a group by line, l_orderkey, l_linenumber, x""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 12).alias("x"), F.lit(1).alias("t"))
    a = spark.createDataFrame([(1, 0, 100.0), (1, 1, 250.0), (1, 2, 400.0), (1, 3, 560.0)], "t int, column int, anchor double")
    return B.nearest_anchor(v.withColumn("px", F.col("x")), a, ["t"], F.col("px")).select("l_orderkey", "l_linenumber", "x", "column")


@query("""with h as (select n_regionkey as t, n_nationkey as row, n_name as label from nation), v as (select n_regionkey as t, n_nationkey * 2 + case when n_nationkey = 3 then 100 else 0 end as row, lower(n_name) || ' ' as label from nation where n_name not like '%2'),
p as (select h.t, h.row as left_row, v.row as right_row from h join v on h.t = v.t and lower(regexp_replace(h.label, '\\s+', '', 'g')) = lower(regexp_replace(v.label, '\\s+', '', 'g'))),
f as (select *, coalesce(right_row <= lag(right_row) over (partition by t order by left_row), false) as falls from p),
g as (select *, bool_or(falls) over (partition by t) as bad, count(*) over (partition by t) as n from f)
select t, left_row, right_row from g where not bad and n >= 2""")
def matched_value_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    h = n.select(F.col("n_regionkey").alias("t"), k.alias("row"), F.col("n_name").alias("label"))
    v = n.where("n_name not like '%2'").select(F.col("n_regionkey").alias("t"), (k * 2 + F.when(k == 3, 100).otherwise(0)).alias("row"), F.concat(F.lower("n_name"), F.lit(" ")).alias("label"))
    return B.matched_rows(h, v, ["t"], "label")


CELLS_SQL = ROWS_SQL + """,
c as (select t, row, e - row as span, (1 + l_partkey % 3) * 11.25::double + 1.4::double as need from r join s using (t, row))"""


@query(f"""with recursive {CELLS_SQL.replace("select t, row, row + case", "select t, row, (row + case").replace("else 1 end as e", "else 1 end)::int as e")},
h as (select t, list_transform(range(0, max(row)::int + 3), lambda x: null::double) as none, list(struct_pack(row := row, span := span, need := need) order by row) as cells from c group by t),
z as (select t, 1 as k, list_filter(cells, lambda x: x.span > 1) as wide,
    list_transform(none, lambda x, i: list_extract(list_transform(list_filter(cells, lambda q: q.row = i - 1 and q.span = 1), lambda q: q.need), 1)) as heights from h
  union all
  select t, k + 1, wide, list_transform(heights, lambda x, i: case when i = wide[k].row + wide[k].span
      then coalesce(x, 11.25::double) + greatest(0, wide[k].need - list_sum(list_transform(heights[wide[k].row + 1 : wide[k].row + wide[k].span], lambda q: coalesce(q, 11.25::double)))) else x end)
  from z where k <= len(wide))
select t, row::int as row, round(height, 4) as height from (select t, unnest(range(len(heights))) as row, unnest(heights) as height from z where k = len(wide) + 1) where height is not null""")
def table_row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.row_heights(_cells(spark, sf_dir), ["t"]).select("t", "row", F.round("height", 4).alias("height"))


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    groups = B.atomic_groups(cells, ["t"])
    heights = cells.groupBy("t", "row").agg(F.max(F.col("lines") * 11.25 + 1.4).alias("h"))
    rows = groups.select("t", "first", "last", F.explode(F.sequence("first", "last")).alias("row")).join(heights, ["t", "row"])
    return B.paginated(rows.groupBy("t", "first", "last").agg(F.sum("h").alias("height")), ["t"], F.lit(120.0), F.lit(240.0))


@query(f"""with recursive {ROWS_SQL},
p as (select t, g, min(row)::int as first, max(row)::int as last, sum((1 + l_partkey % 3) * 11.25::double + 1.4::double) as height from i join r using (t, row) group by t, g),
o as (select *, row_number() over (partition by t order by first) as k from p),
z as (select t, k, first, last, height, case when height > 120 and height <= 240 then 1 else 0 end as page, case when height > 120 and height <= 240 then 240.0::double else 120.0::double end - height as room from o where k = 1
  union all
  select o.t, o.k, o.first, o.last, o.height, case when o.height > z.room then z.page + 1 else z.page end, case when o.height > z.room then 240.0::double else z.room end - o.height
  from z join o on z.t = o.t and o.k = z.k + 1)
select t, first, last, round(height, 4) as height, page from z""")
def table_paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, sf_dir).select("t", "first", "last", F.round("height", 4).alias("height"), "page")


@query(f"""with {ROWS_SQL}, p as (select t, min(row)::int as first, max(row)::int as last from i group by t, g)
select t, unnest(range(first, last + 1))::int as row, case when t % 3 = 0 then 0 else 2 end::bigint as times from p where first = 0 and t % 3 < 2""")
def table_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pages lose or repeat: of every third table the first group is gone, of every other third it comes twice."""
    paged = _paged(spark, sf_dir).select("t", "first", "last")
    start, third = F.col("first") == 0, F.col("t") % 3
    spoiled = paged.where(~(start & (third == 0))).unionByName(paged.where(start & (third == 1)))
    return B.coverage_faults(spoiled, ["t"], _cells(spark, sf_dir).select("t", "row").distinct())


@query("select t, count(*) as rows, true as whole from (select l_orderkey // 8 as t from lineitem) group by t")
def table_pages_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pagination itself loses and repeats no row."""
    cells = _cells(spark, sf_dir).select("t", "row").distinct()
    faults = B.coverage_faults(_paged(spark, sf_dir).select("t", "first", "last"), ["t"], cells).groupBy("t").agg(F.count("*").alias("bad"))
    return cells.groupBy("t").agg(F.count("*").alias("rows")).join(faults, "t", "left").select("t", "rows", F.col("bad").isNull().alias("whole"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as an HTML table with a spanning header and a first cell that spans all rows."""
    whole = Window.partitionBy("l_orderkey")
    order = whole.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").select("*", F.row_number().over(order).alias("k"), F.count("*").over(whole).alias("n"))
    first = F.concat(F.lit("<td rowspan="), F.col("n").cast("string"), F.lit(">"), F.col("l_orderkey").cast("string"), F.lit("</td>"))
    row = F.concat(
        F.lit("<tr>"), F.when(F.col("k") == 1, first).otherwise(""), F.lit("<td>"), F.col("l_partkey").cast("string"),
        F.lit("<td>"), F.col("l_returnflag"), F.lit("</td></tr>"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("r")))), lambda x: x["r"]), "")
    head = "<table><tr><th colspan=3>Order lines</th></tr><tr><th>Order</th><th>Part</th><th>Flag</th></tr>"
    return li.groupBy("l_orderkey").agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("content"))


@query("""with l as (select *, count(*) over (partition by l_orderkey) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) + 1 as r from lineitem),
o as (select distinct l_orderkey, n from l)
select l_orderkey, 0::int as row, 0::int as "column", 1::int as row_span, 3::int as column_span, 'Order lines' as text, true as header from o
union all select l_orderkey, 1, c::int, 1, 1, ['Order', 'Part', 'Flag'][c + 1], true from o, range(3) t(c)
union all select l_orderkey, 2, 0, least(n, 100)::int, 1, l_orderkey::varchar, false from o
union all select l_orderkey, r::int, 1, 1, 1, l_partkey::varchar, false from l
union all select l_orderkey, r::int, 2, 1, 1, l_returnflag, false from l""")
def table_grid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.extracted(_html(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "row", "column", "row_span", "column_span", "text", "header")


@query("select distinct l_orderkey, 'Order lines' || chr(10) || 'Order' || chr(10) || 'Part' || chr(10) || 'Flag' as header_text from lineitem")
def table_header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.header_text(B.extracted(_html(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"])


@query("""select c_custkey, 0::int as row, unnest([0, 1])::int as "column", unnest(['name', 'a|b']) as text, true as header from customer
union all select c_custkey, 1, 0, c_name, false from customer union all select c_custkey, 1, 1, c_mktsegment, false from customer""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("| name | a\\|b |\n|---|:--:|\n| "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |")).alias("content"))
    return B.extracted(c, ["c_custkey"]).select("c_custkey", "row", "column", "text", "header")


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_html(table(spark, sf_dir, "pages"))


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = parsed_html(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page_idx"), "n", "type", "text")
    return U.markdown(b)


# Geometry of pages


@query("""with t as (select conv_id, turn, length(text) as n from conversations)
select conv_id, turn, round(n * 0.5 * 9, 4)::double as width, greatest(1, ceil(n * 0.5 * 9 / 300))::int as lines from t""")
def text_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.round(Y.text_width(F.col("text"), 9.0), 4).alias("width"), Y.line_count(F.col("text"), 9.0, 300.0).alias("lines"))


@query("""with c as (select conv_id, turn, length(text) as n from conversations)
select conv_id, turn, list_max(list_filter(list_transform(range(25), lambda k: 12 - k / 4), lambda s: greatest(1, ceil(n * 0.5::double * s / 300)) * s * 1.25::double <= 60))::double as size,
  array_to_string(list_transform(range(6), lambda k: round(12 * pow(0.78::double, k), 4)::varchar), ',') as ladder from c""")
def font_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", Y.fitted_size(F.col("text"), F.lit(300.0), F.lit(60.0), 12.0, 6.0).alias("size"), F.array_join(Y.font_ladder(F.lit(12.0)).cast("array<string>"), ",").alias("ladder"))


@query(f"""with recursive {LINES_SQL}, a as (
  select doc_id, page_idx, n, y0 as wanted, 11.25::double * (1 + n % 3) as h, row_number() over (partition by doc_id, page_idx order by n) as k from lines
), gaps as (select 11.25::double - 1.125::double * unnest(range(7)) as gap),
z as (
  select doc_id, page_idx, 0::bigint as k, 36.0::double as y, gap, null::double as top from (select distinct doc_id, page_idx from a) cross join gaps
  union all
  select doc_id, page_idx, k, put + h + gap, gap, put from (
    select doc_id, page_idx, k, h, gap, case when free < 240 and free + h > 200 then 244.5::double else free end as put from (
      select a.doc_id, a.page_idx, a.k, a.h, z.gap, greatest(z.y, case when z.gap = 11.25 then least(a.wanted, 516) else z.y end) as free
      from z join a on z.doc_id = a.doc_id and z.page_idx = a.page_idx and a.k = z.k + 1))
  where put + h <= 516 + 1e-9
), best as (
  select doc_id, page_idx, gap from (select doc_id, page_idx, gap, max(k) as fit from z group by all)
  qualify row_number() over (partition by doc_id, page_idx order by fit desc, gap desc) = 1
), tops as (select z.* from z join best using (doc_id, page_idx, gap))
select a.doc_id, a.page_idx, a.n, round(t.top, 4) as top from a left join tops t on a.doc_id = t.doc_id and a.page_idx = t.page_idx and a.k = t.k""")
def vertical_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    items = F.array_sort(F.collect_list(F.struct(F.col("n").alias("k"), F.col("bbox.y0").alias("y"), (11.25 * (1 + F.col("n") % 3)).alias("h"))))
    p = b.groupBy("doc_id", "page_idx").agg(items.alias("i"))
    placed = p.select("doc_id", "page_idx", "i", Y.stacked_udf(F.transform("i", lambda x: F.array(x["y"], x["h"])), F.lit(36.0), F.lit(516.0), F.array(F.array(F.lit(200.0), F.lit(240.0)))).alias("t"))
    return placed.select("doc_id", "page_idx", F.explode(F.arrays_zip("i", "t")).alias("z")).select("doc_id", "page_idx", F.col("z.i.k").alias("n"), F.round("z.t", 4).alias("top"))


@query()
def continuation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(texts.alias("t"))
    return c.select("conv_id", F.posexplode(Y.continued_udf("t", F.lit(500.0), F.lit(700.0), F.lit(150.0))).alias("k", "p")).select("conv_id", "k", "p.page", "p.item", "p.piece")
