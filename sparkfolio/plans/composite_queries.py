"""Queries over composite operators: enrichment, styles, table texts, ledgers, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.adapters import RefusingTranslator, StaticTranslator
from sparkfolio.functions import geometry as G
from sparkfolio.functions import text as X
from sparkfolio.operators import composites as C
from sparkfolio.operators import units as U
from sparkfolio.plans.layout_queries import BANDS_SQL, blocks
from sparkfolio.plans.registry import query, table
from sparkfolio.plans.text_queries import _WIDE, collapsed_sql, heading_sql, locked_sql
from sparkfolio.sources.lines import LINES_SQL, PAGE_HEIGHT, PAGE_WIDTH, regions


@query(f"""with {LINES_SQL}, e as (select *, case when type = 'paragraph_title' then 'section_heading' else type end as kind from regions),
best as (
  select l.doc_id, l.page_idx, l.n as idx, l.text, r.region_idx, greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)) as shared
  from lines l join e r on l.doc_id = r.doc_id and l.page_idx = r.page_idx and r.kind = 'table'
  qualify row_number() over (partition by l.doc_id, l.page_idx, l.n order by shared desc, region_idx) = 1
), owned as (select * from best qualify row_number() over (partition by doc_id, page_idx, region_idx order by shared desc, idx) = 1),
rest as (select l.*, row_number() over (partition by doc_id, page_idx order by n) - 1 as k from lines l where (doc_id, page_idx, n) not in (select (doc_id, page_idx, idx) from owned)),
top as (select doc_id, page_idx, max(region_idx) + 1 as top from e group by all)
select e.doc_id, e.page_idx, e.region_idx, e.kind as type, o.text as content from e left join owned o using (doc_id, page_idx, region_idx)
union all select doc_id, page_idx, (coalesce(top, 0) + k)::int, 'table', text from rest left join top using (doc_id, page_idx)""")
def enriched_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    contents = b.select("doc_id", "page_idx", F.col("n").alias("idx"), F.lit("Table").alias("type"), "bbox", F.col("text").alias("content"))
    return C.enriched(regions(b), contents).drop("bbox")


@query(f"""with {LINES_SQL}, inside as (
  select distinct l.doc_id, l.page_idx, r.region_idx, l.text, round((l.y0 + l.y1) / 2, 2) as y, round((l.x0 + l.x1) / 2, 2) as x from lines l join regions r on r.type = 'table' and r.doc_id = l.doc_id and r.page_idx = l.page_idx
    and (l.x0 + l.x1) / 2 between r.x0 - 1 and r.x1 + 1 and (l.y0 + l.y1) / 2 between r.y0 - 1 and r.y1 + 1
) select *, (row_number() over (partition by doc_id, page_idx, region_idx order by y, x, text) - 1)::int as position from inside""")
def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return C.contained_texts(regions(b).where("type = 'table'"), b).select("doc_id", "page_idx", "region_idx", "text", "y", "x", "position")


@query(f"""with {LINES_SQL}
select doc_id, page_idx, n, page_idx = 0 and y0 <= 0.25 * {PAGE_HEIGHT} and not numbered as title,
  case when abs((x0 + x1) / 2 - {PAGE_WIDTH} / 2) <= 0.03 * {PAGE_WIDTH} and x1 - x0 <= 0.8 * {PAGE_WIDTH} then 'center' when x0 > {PAGE_WIDTH} / 2 then 'right' else 'left' end as align
from (select *, {heading_sql(collapsed_sql("text"))} as numbered from lines)""")
def heading_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    title, align = C.heading_style(F.col("bbox"), F.col("text"), PAGE_WIDTH, PAGE_HEIGHT, F.col("page_idx"))
    return b.select("doc_id", "page_idx", "n", title.alias("title"), align.alias("align"))


@query(f"""with {LINES_SQL}, v as (select doc_id, page_idx, x0, y0, x1, y1, case n % 4 when 0 then 'image' when 1 then 'equation' when 2 then 'chart' else 'text' end as type from lines)
select distinct on (doc_id, page_idx, x0, y0, x1, y1) doc_id, page_idx, x0, y0, x1, y1, type from v where type <> 'text'""")
def preserved_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("figure", "Formula", "chart", "text"))), (F.col("n") % 4 + 1).cast("int"))
    return C.pixel_regions(regions(b), b.withColumn("type", kind)).select("doc_id", "page_idx", "x0", "y0", "x1", "y1", "type")


@query(f"""with {LINES_SQL}
select doc_id, n, case when x1 - x0 < 0.18 * 540 then 'narrow' when y1 - y0 < 8 then 'low'
  when greatest(1, ceil((length(text) + len(regexp_extract_all(text, '{_WIDE}'))) * 0.5 * 9 / (x1 - x0))) * 9 * 1.25 > y1 - y0 then 'overflow' end as reason from lines""")
def unsafe_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return b.select("doc_id", "n", C.unsafe_area(F.col("bbox"), F.col("text"), 540.0).alias("reason"))


@query("""with p as (select p_partkey // 8 as doc_id, (p_partkey % 8)::int as page_idx, case when p_size % 4 = 0 then null else 600.0 end::double as width, 800.0::double as height, (p_size % 4 * 90)::int as angle from part where p_type <> 'ECONOMY'),
e as (select p_partkey // 8 as doc_id, (p_partkey % 8)::int as page_idx from part)
select e.doc_id, e.page_idx, case when p.width is not null then p.width else 500.0 end::double as width, case when p.width is not null then 800.0 else 700.0 end::double as height, coalesce(p.angle, 0)::int as angle from e left join p using (doc_id, page_idx)""")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = [F.floor(F.col("p_partkey") / 8).alias("doc_id"), (F.col("p_partkey") % 8).cast("int").alias("page_idx")]
    pages = part.where("p_type <> 'ECONOMY'").select(*key, F.when(F.col("p_size") % 4 != 0, 600.0).alias("width"), F.lit(800.0).alias("height"), (F.col("p_size") % 4 * 90).cast("int").alias("angle"))
    elements = part.select(*key, F.lit(0).alias("idx"), F.lit(500.0).alias("page_width"), F.lit(700.0).alias("page_height"))
    return C.page_sizes(pages, elements)


@query("""with p as (select o_custkey as doc_id, o_orderkey as page_idx, 3::bigint as blocks, length(o_orderpriority)::bigint as corrections, o_orderstatus as metadata, case when o_orderstatus = 'P' then 90 else 0 end as angle, round(o_totalprice) as dpi from orders)
select doc_id, count(*) as pages, sum(blocks)::bigint as blocks, sum(corrections)::bigint as corrections, arg_min(metadata, page_idx) as metadata, coalesce(string_agg(case when angle <> 0 then page_idx::varchar end, ',' order by page_idx), '') as retried, max(dpi)::double as dpi from p group by doc_id""")
def merged_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_idx"), F.lit(3).cast("long").alias("blocks"), F.length("o_orderpriority").cast("long").alias("corrections"),
        F.col("o_orderstatus").alias("metadata"), F.when(F.col("o_orderstatus") == "P", 90).otherwise(0).alias("angle"), F.round("o_totalprice").alias("dpi"),
    )
    return C.merged_layouts(p)


@query("""with e as (select md5(user_id::varchar) as job_id, event_type as stage, case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'running' end as status, event_id::double as progress, ts from events),
l as (select * from e qualify row_number() over (partition by job_id order by ts desc, progress desc) = 1)
select job_id, status, stage, progress, case when status = 'done' then '/jobs/' || job_id || '/out.json' end as ledger from l""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = F.md5(F.col("user_id").cast("string"))
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    m = table(spark, sf_dir, "events").select(
        job.alias("job_id"), F.col("event_type").alias("stage"), status.alias("status"), F.col("event_id").cast("double").alias("progress"), F.col("ts").alias("at"), F.concat(F.lit("/jobs/"), job).alias("folder")
    )
    return C.job_status(m, {"ledger": "out.json"})


@query(f"""with {LINES_SQL} select doc_id, page_idx, 'p' || (page_idx + 1) || '-e' || (n + 1) as element_id, 'text' as type, text as source_text, '' as text, 8.0::double as font_size from lines""")
def spec_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spec_template(blocks(spark, sf_dir)).select("doc_id", "page_idx", "element_id", "type", "source_text", "text", "font_size")


@query("""with c as (select l_orderkey as "table", (l_linenumber - 1)::int as first, (l_linenumber - 1 + case when l_returnflag = 'R' then 1 else 0 end)::int as last from lineitem),
n as (select "table", count(*) as n, count(distinct c) as d from (select "table", unnest(range(first, last + 1)) as c from c) group by 1),
w as (select l_orderkey as "table", max(l_linenumber)::bigint as columns from lineitem group by 1)
select w."table", n.n = columns and n.d = columns as covered from w left join n using ("table")""")
def column_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    spans = li.select(F.col("l_orderkey").alias("table"), (F.col("l_linenumber") - 1).alias("first"), (F.col("l_linenumber") - 1 + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("last"))
    return C.disjoint_cover(spans, li.groupBy(F.col("l_orderkey").alias("table")).agg(F.max("l_linenumber").alias("columns")))


@query(f"""with {LINES_SQL}, c as (select unnest(range(10))::int as k), p as (
  select doc_id, n, text, k, (x0 + x1) / 2 between 60.0 * k and 60.0 * k + 50 as inside, pow((x0 + x1) / 2 - (60.0 * k + 25), 2) + pow((y0 + y1) / 2 - 276, 2) as far from lines, c
), a as (select * from p qualify row_number() over (partition by doc_id, n order by inside desc, far, k) = 1)
select doc_id as "table", 9::int as row, k as "column", string_agg(text, chr(10) order by n) as text from a group by all""")
def trailing_row_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = blocks(spark, sf_dir).select(F.col("doc_id").alias("table"), "n", "text", "bbox")
    ten = F.sequence(F.lit(0), F.lit(9))
    cells = texts.select("table").distinct().select("table", F.lit(9).alias("row"), F.explode(ten).alias("column"))
    cells = cells.withColumn("bbox", G.box(60.0 * F.col("column"), F.lit(0.0), 60.0 * F.col("column") + 50, F.lit(552.0)))
    return C.recovered_trailing(texts, cells).select("table", "row", "column", "text")


@query("""with recursive w as (select p_partkey as t, unnest(range(len(a)))::int as k, unnest(a) as word from (select p_partkey, string_split(p_name, ' ') as a from part)),
c as (select t, k as cell, word as text from w union all select p_partkey, 9, p_name from part),
o as (select *, row_number() over (partition by t order by cell) as i from (
  select c.t, c.cell, list(w.k) as ks from c join w on c.t = w.t and w.word <> '' and contains(lower(c.text), lower(w.word)) group by all)),
z as (select distinct t, 0::bigint as i, -1 as cell, null::int as hit, -1 as reached from o
  union all
  select t, i, cell, hit, coalesce(hit, reached) from (
    select o.t, o.i, o.cell, list_min(list_filter(o.ks, lambda x: x > z.reached)) as hit, z.reached from z join o on z.t = o.t and o.i = z.i + 1))
select t as "table", cell, hit as first, hit as last from z where hit is not null""")
def header_column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as header cells over the words they are made of."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.col("p_partkey").alias("table"), F.posexplode(F.split("p_name", " ")).alias("k", "text"))
    texts = words.select("table", (100.0 * F.col("k") + F.col("table") % 9).alias("x"), "text")
    cells = words.select("table", F.col("k").alias("cell"), "text").unionByName(part.select(F.col("p_partkey").alias("table"), F.lit(9).alias("cell"), F.col("p_name").alias("text")))
    anchors = words.select("table", F.col("k").alias("column"), (100.0 * F.col("k")).alias("anchor"))
    return C.header_columns(texts, cells, anchors)


CLEAR_SQL = BANDS_SQL + """, clear as (
  select l.* from lines l left join bands using (doc_id, page_idx)
  where not coalesce((y0 + y1) / 2 <= header_bottom or header_bottom is not null and greatest(0, least(y1, header_bottom) - y0) / (y1 - y0) >= 0.5
    or (y0 + y1) / 2 >= footer_top or footer_top is not null and greatest(0, y1 - greatest(y0, footer_top)) / (y1 - y0) >= 0.5, false) and type = 'text'
)"""


@query(f"with {CLEAR_SQL} select doc_id, page_idx, n::varchar as members from clear where length(text) < 30 or {heading_sql(collapsed_sql('text'))}")
def heading_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    kind = F.when((F.length("text") < 30) & (F.col("type") == "text"), "paragraph_title").otherwise(F.col("type"))
    out = C.heading_units(b.withColumn("type", kind), regions(b), PAGE_WIDTH, PAGE_HEIGHT)
    return out.select("doc_id", "page_idx", F.array_join(F.array_sort("members").cast("array<string>"), ",").alias("members"))


@query(f"""with {CLEAR_SQL}, held as (
  select c.*, min(r.region_idx) as region_idx from clear c left join regions r on r.type = 'text' and c.doc_id = r.doc_id and c.page_idx = r.page_idx
    and least(c.x1, r.x1) > greatest(c.x0, r.x0) and least(c.y1, r.y1) > greatest(c.y0, r.y0) group by all
)
select doc_id, page_idx, coalesce(region_idx, -1 - n)::int as unit, string_agg(text, ' ' order by y0, x0, text) as text from held group by all""")
def body_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return C.body_units(b, regions(b), PAGE_WIDTH, PAGE_HEIGHT)


UNITS_SQL = """u as (select conv_id as doc_id, conv_id * 1000 + turn as unit_id, case role when 'user' then 'body' when 'system' then 'heading' else 'cell' end as kind, (turn // 3)::int as page_idx, (turn % 2)::double as y, text from conversations),
p as (select *, (row_number() over (partition by doc_id order by page_idx, y, case kind when 'heading' then 0 when 'body' then 1 else 2 end, unit_id) - 1)::int as position from u),
w as (select *, regexp_matches(text, '[A-Za-z]') and not regexp_matches(text, '{wide}') and not {locked} as wanted from p)"""
UNITS_SQL = UNITS_SQL.replace("{wide}", _WIDE).replace("{locked}", locked_sql("text"))


def _turn_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "body").when(F.col("role") == "system", "heading").otherwise("cell")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), kind.alias("kind"),
        F.floor(F.col("turn") / 3).cast("int").alias("page_idx"), (F.col("turn") % 2).cast("double").alias("y"), F.lit(0.0).alias("x"), "text",
    )


@query(f"""with {UNITS_SQL} select doc_id, unit_id, kind, page_idx, position, text as source, case when wanted then '~' || text else text end as target,
  wanted as translated, wanted::int as attempts, cast(null as varchar) as error from w""")
def translation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as units, translated by the double that puts a mark before each text."""
    return C.translation_ledger(_turn_units(spark, sf_dir), StaticTranslator(), "zh")


@query(f"""with {UNITS_SQL} select doc_id, unit_id, kind, page_idx, position, text as source, case when wanted and not contains(text, 'q') then '~' || text else text end as target,
  wanted as translated, case when wanted and contains(text, 'q') then 'refused' end as error from w""")
def translation_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a double that refuses texts with one letter: attempts, cuts in two, and a row that says why there is no text."""
    return C.translation_ledger(_turn_units(spark, sf_dir), RefusingTranslator("q"), "zh").drop("attempts")


@query("""with f as (select conv_id, turn, unnest(range(len(a)))::int as fragment, unnest(a) as piece, p, q from (
  select conv_id, turn, string_split(text, chr(10)) as a, lag(text) over w as p, lead(text) over w as q from conversations window w as (partition by conv_id order by turn)))
select conv_id, turn, fragment, piece, coalesce(lag(piece) over w, p) as before, coalesce(lead(piece) over w, q) as after from f window w as (partition by conv_id, turn order by fragment)""")
def fragment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_id"), F.col("turn").alias("position"), "text")
    out = U.fragments(U.with_context(c), F.split("text", "\n"))
    return out.select(F.col("doc_id").alias("conv_id"), F.col("unit_id").alias("turn"), "fragment", "piece", "before", "after")


@query("""select doc_id, text as kept from documents qualify row_number() over (partition by sha256(text) order by doc_id) = 1""")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("kept"), F.sha2("text", 256).alias("k"))
    return U.first_wins(docs, ["k"], "doc_id").drop("k")


@query("""with p as (select c_custkey, case when c_custkey % 3 = 0 then c_name else lower(c_name) end as n from customer) select c_custkey, n = lower(n) as lower_case, length(n)::int as chars from p""")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(X.casefold(F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", n.alias("n")).select("c_custkey", (F.col("n") == F.lower("n")).alias("lower_case"), F.length("n").alias("chars"))


@query("""with d as (select p_partkey, 300.0 + p_size * 40 as px, 612.0 as w from part) select p_partkey, round(greatest(px * 72 / w, px * 72 / 792.0), 6)::double as dpi, (px * 72 / w > 150)::boolean as fine from d""")
def image_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = 300.0 + F.col("p_size") * 40
    dpi = G.image_dpi(F.lit(612.0), F.lit(792.0), px, px)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(dpi, 6).alias("dpi"), (dpi > 150).alias("fine"))


@query("""with b as (select o_orderkey, (o_orderkey % 50)::double as x0, (o_orderkey % 50 + 10 + o_orderkey % 7)::double as x1, 5.0::double as y0, (9 + o_orderkey % 5)::double as y1, (o_orderkey % 4 * 90) as a from orders)
select o_orderkey, case when a % 180 = 90 then greatest(0, y1 - y0 - 3) else greatest(0, x1 - x0 - 3) end::double as width, case when a % 180 = 90 then greatest(0, x1 - x0 - 3) else greatest(0, y1 - y0 - 3) end::double as height from b""")
def inner_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    b = G.box(k % 50, F.lit(5), k % 50 + 10 + k % 7, 9 + k % 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", G.inner_size(b, F.lit(1.5), k % 4 * 90).alias("s")).select("o_orderkey", "s.width", "s.height")




@query(f"""with {BANDS_SQL}, k as (
  select *, case when type <> 'text' then type when page_idx % 3 = 2 then 'image' when n % 6 = 2 then 'equation' else 'text' end as kind from lines
), p as (select doc_id, page_idx, bool_or(kind = 'image') and not bool_or(kind = 'text') as pixels from k group by all)
select doc_id, page_idx, n, case when pixels then 'visual_page' when kind in ('page_header', 'page_footer') then 'furniture' when kind = 'equation' then 'formula' when kind = 'image' then 'visual_or_table'
  when coalesce((y0 + y1) / 2 <= header_bottom or header_bottom is not null and greatest(0, least(y1, header_bottom) - y0) / (y1 - y0) >= 0.5
    or (y0 + y1) / 2 >= footer_top or footer_top is not null and greatest(0, y1 - greatest(y0, footer_top)) / (y1 - y0) >= 0.5, false) then 'furniture' else 'source' end as disposition
from k join p using (doc_id, page_idx) left join bands using (doc_id, page_idx)""")
def source_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents: whether the layer has it, or why not."""
    kind = F.when(F.col("type") != "text", F.col("type")).when(F.col("page_idx") % 3 == 2, "image_body").when(F.col("n") % 6 == 2, "display_formula").otherwise("text")
    return C.source_layer(blocks(spark, sf_dir).withColumn("type", kind), PAGE_HEIGHT).select("doc_id", "page_idx", "n", "disposition")


@query("""with r as (select l_orderkey // 8 as t, row_number() over (partition by l_orderkey // 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::int as row, l_partkey::varchar as part_key, l_returnflag as flag from lineitem),
p as (select *, case when row <= 8 then 0 else 1 + (row - 9) // 17 end::int as part, 1 + case when row <= 8 then row - 1 else (row - 9) % 17 end as above from r),
c as (select t, part, row, 0 as "column", false as header, part_key as text, above from p union all select t, part, row, 1, false, flag, above from p
  union all select t, part, 0, 0, true, 'Part', 0 from (select distinct t, part from p) union all select t, part, 0, 1, true, 'Flag', 0 from (select distinct t, part from p))
select t, part, row, "column", header, text, round(above * 12.65::double, 4) as y0, round((above + 1) * 12.65::double, 4) as y1 from c""")
def table_redraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of eight orders as a table of two columns over pages: eight rows fit the first, seventeen each later one."""
    w = Window.partitionBy("t").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("t", F.expr("l_orderkey div 8")).select("t", F.row_number().over(w).alias("row"), "l_partkey", "l_returnflag")
    cell = lambda row, column, header, text: F.struct(row.alias("row"), F.lit(column).alias("column"), F.lit(header).alias("header"), text.alias("text"))
    own = F.array(cell(F.col("row"), 0, False, F.col("l_partkey").cast("string")), cell(F.col("row"), 1, False, F.col("l_returnflag")))
    head = F.array(cell(F.lit(0), 0, True, F.lit("Part")), cell(F.lit(0), 1, True, F.lit("Flag")))
    cells = lines.select("t", F.inline(F.when(F.col("row") == 1, F.concat(head, own)).otherwise(own))).select("*", F.lit(1).alias("row_span"), F.lit(1).alias("column_span"))
    out = C.redrawn_tables(cells, ["t"], 400.0, 120.0, 240.0)
    return out.select("t", "part", "row", "column", "header", "text", F.round("y0", 4).alias("y0"), F.round("y1", 4).alias("y1"))
