"""Queries over positioned lines: typing, assignment, bands, neighbours, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions import geometry as G
from sparkfolio.operators import regions as R
from sparkfolio.operators import semantics as S
from sparkfolio.plans.registry import query, table
from sparkfolio.sources.lines import LINES_SQL, PAGE_HEIGHT, PAGE_WIDTH, lines, regions


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).where("bbox is not null")


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks moved by a few points, so that they straddle regions."""
    b = F.col("bbox")
    dy, dx = (F.col("n") * 7) % 11 - 5, (F.col("n") * 5) % 13 - 6
    return blocks(spark, sf_dir).withColumn("bbox", G.box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy))


def _flat(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


SHIFTED_SQL = LINES_SQL + """, shifted as (
  select doc_id, n, page_idx, text, type, x0 + (n * 5) % 13 - 6 as x0, y0 + (n * 7) % 11 - 5 as y0,
    x1 + (n * 5) % 13 - 6 as x1, y1 + (n * 7) % 11 - 5 as y1 from lines
), pairs as (
  select s.doc_id, s.page_idx, s.n, s.text, r.region_idx, r.type, r.confidence,
    s.x0 as ax0, s.y0 as ay0, s.x1 as ax1, s.y1 as ay1, r.x0 as bx0, r.y0 as by0, r.x1 as bx1, r.y1 as by1,
    greatest(0, least(s.x1, r.x1) - greatest(s.x0, r.x0)) as ox, greatest(0, least(s.y1, r.y1) - greatest(s.y0, r.y0)) as oy,
    (s.x1 - s.x0) * (s.y1 - s.y0) as aa, (r.x1 - r.x0) * (r.y1 - r.y0) as ba
  from shifted s join regions r using (doc_id, page_idx)
)"""


@query(f"with {LINES_SQL} select doc_id, n, page_idx, text, type, x0, y0, x1, y1 from lines")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(blocks(spark, sf_dir), "doc_id", "n", "page_idx", "text", "type")


@query(f"with {LINES_SQL} select doc_id, page_idx, region_idx, x0, y0, x1, y1 from merged")
def line_box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(regions(blocks(spark, sf_dir)), "doc_id", "page_idx", "region_idx")


@query(f"""with {SHIFTED_SQL}, held as (
  select *, ((ax0 + ax1) / 2 between bx0 and bx1 and (ay0 + ay1) / 2 between by0 and by1)::int as inside, ox * oy / aa as cover from pairs
), best as (
  select doc_id, page_idx, n, type, region_idx from held where inside = 1 or cover >= 0.5
  qualify row_number() over (partition by doc_id, page_idx, n order by inside desc, cover desc, confidence desc, ba, region_idx) = 1
)
select s.doc_id, s.page_idx, s.n, coalesce(b.type, 'text') as type, b.region_idx
from shifted s left join best b using (doc_id, page_idx, n)""")
def block_region_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(blocks(spark, sf_dir))
    return R.typed_blocks(shifted(spark, sf_dir), r).select("doc_id", "page_idx", "n", "type", "region_idx")


@query(f"with {SHIFTED_SQL} select doc_id, page_idx, region_idx, n from pairs where ox * oy > 0")
def region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.members(regions(blocks(spark, sf_dir)), shifted(spark, sf_dir))


@query(f"""with {SHIFTED_SQL}
select doc_id, page_idx, n, region_idx, round(ox * oy / least(aa, ba), 6) as score from pairs where ox * oy > 0
qualify row_number() over (partition by doc_id, page_idx, n order by ox * oy / least(aa, ba) desc, region_idx desc) = 1""")
def heading_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_region(shifted(spark, sf_dir), regions(blocks(spark, sf_dir)))


@query(f"""with {SHIFTED_SQL}, scored as (
  select *, round(ox * oy / least(aa, ba) + oy / least(ay1 - ay0, by1 - by0), 9) as score from pairs where ox * oy > 0
)
select doc_id, page_idx, n, region_idx, score from scored
qualify row_number() over (partition by doc_id, page_idx, n order by score desc, region_idx desc) = 1""")
def exclusive_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assigned(regions(blocks(spark, sf_dir)), shifted(spark, sf_dir))


@query(f"""with {LINES_SQL}, few as (select * from regions where type in ('table', 'paragraph_title'))
select doc_id, page_idx, n from lines l where not exists (
  select 1 from few r where r.doc_id = l.doc_id and r.page_idx = l.page_idx
    and least(l.x1, r.x1) > greatest(l.x0, r.x0) and least(l.y1, r.y1) > greatest(l.y0, r.y0))""")
def uncovered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return R.uncovered(b, regions(b).where("type in ('table', 'paragraph_title')")).select("doc_id", "page_idx", "n")


BANDS_SQL = LINES_SQL + f""", anchors as (
  select doc_id, page_idx, max(case when furniture and (y0 + y1) / 2 < {PAGE_HEIGHT / 2} then y1 end) as head,
    min(case when furniture and (y0 + y1) / 2 >= {PAGE_HEIGHT / 2} then y0 end) as foot
  from (select *, type in ('page_header', 'page_footer') as furniture from lines) group by all
), more as (
  select doc_id, page_idx,
    max(case when y0 < head and y1 <= head + 0.03 * {PAGE_HEIGHT} then least(y1, head + 0.008 * {PAGE_HEIGHT}) end) as head_more,
    min(case when y1 > foot and y0 >= foot - 0.03 * {PAGE_HEIGHT} then greatest(y0, foot - 0.008 * {PAGE_HEIGHT}) end) as foot_more
  from lines join anchors using (doc_id, page_idx) where type = 'text' group by all
), bands as (
  select doc_id, page_idx, greatest(head, head_more) as header_bottom, least(foot, foot_more) as footer_top
  from anchors left join more using (doc_id, page_idx)
)"""


@query(f"with {BANDS_SQL} select * from bands")
def furniture_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.furniture_bands(blocks(spark, sf_dir), PAGE_HEIGHT)


@query(f"""with {BANDS_SQL}
select doc_id, page_idx, n from lines left join bands using (doc_id, page_idx)
where not coalesce((y0 + y1) / 2 <= header_bottom or header_bottom is not null and greatest(0, least(y1, header_bottom) - y0) / (y1 - y0) >= 0.5, false)
  and not coalesce((y0 + y1) / 2 >= footer_top or footer_top is not null and greatest(0, y1 - greatest(y0, footer_top)) / (y1 - y0) >= 0.5, false)""")
def furniture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return R.outside_bands(b, R.furniture_bands(b, PAGE_HEIGHT)).select("doc_id", "page_idx", "n")


@query(f"""with {LINES_SQL}
select a.doc_id, a.page_idx, a.n, max(case when b.y1 <= a.y0 then b.y1 end) as above, min(case when b.y0 >= a.y1 then b.y0 end) as below
from lines a left join lines b on a.doc_id = b.doc_id and a.page_idx = b.page_idx and a.n <> b.n
  and greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) >= 0.08
group by all""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.neighbours(blocks(spark, sf_dir))


@query(f"""with {LINES_SQL}
select doc_id, page_idx, n from lines l where exists (
  select 1 from regions r where r.type = 'table' and r.doc_id = l.doc_id and r.page_idx = l.page_idx
    and r.y0 - l.y1 <= 0.04 * {PAGE_HEIGHT} and r.y0 - l.y1 >= -0.015 * {PAGE_HEIGHT}
    and greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) / (l.x1 - l.x0) >= 0.25)""")
def table_caption_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return R.table_captions(b, regions(b), PAGE_HEIGHT)


AFTER_SQL = f"""after as (
  select distinct l.doc_id, l.page_idx, l.n from lines l join regions h on h.type = 'paragraph_title'
    and h.doc_id = l.doc_id and h.page_idx = l.page_idx
    and l.y0 - h.y1 >= 0 and l.y0 - h.y1 <= 0.04 * {PAGE_HEIGHT}
    and greatest(0, greatest(l.x0, h.x0) - least(l.x1, h.x1)) <= 0.08 * {PAGE_WIDTH}
)"""


@query(f"with {LINES_SQL}, {AFTER_SQL} select * from after")
def follows_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    headings = regions(b).where("type = 'paragraph_title'")
    return R.follows_heading(b, headings, PAGE_WIDTH, PAGE_HEIGHT)


@query(f"""with {LINES_SQL}, {AFTER_SQL}, caption as (
  select distinct l.doc_id, l.page_idx, l.n from lines l join regions r on r.type = 'table' and r.doc_id = l.doc_id and r.page_idx = l.page_idx
    and r.y0 - l.y1 <= 0.04 * {PAGE_HEIGHT} and r.y0 - l.y1 >= -0.015 * {PAGE_HEIGHT}
    and greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) / (l.x1 - l.x0) >= 0.25
), covered as (
  select l.doc_id, l.page_idx, l.n,
    max(greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)) / ((l.x1 - l.x0) * (l.y1 - l.y0))) as c
  from lines l join regions r on r.type = 'table' and r.doc_id = l.doc_id and r.page_idx = l.page_idx group by all
)
select l.doc_id, l.page_idx, l.n from lines l left join (select *, true as a from after) using (doc_id, page_idx, n)
left join (select *, true as k from caption) using (doc_id, page_idx, n) left join covered using (doc_id, page_idx, n)
where (l.x1 - l.x0 >= 0.22 * {PAGE_WIDTH} or coalesce(a, false)) and (l.y0 >= 0.1 * {PAGE_HEIGHT} or coalesce(a, false))
  and coalesce(c, 0) < 0.08 and not coalesce(k, false)""")
def body_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return R.admitted(b, regions(b), PAGE_WIDTH, PAGE_HEIGHT)


NESTED_SQL = LINES_SQL + """, nested as (
  select doc_id, page_idx, region_idx, x0, y0, x1, y1 from merged union all
  select doc_id, page_idx, 1000 + (region_idx // 3)::int, min(x0), min(y0), max(x1), max(y1) from merged group by all
)"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and wider ones around each three of them."""
    r = regions(blocks(spark, sf_dir)).select("doc_id", "page_idx", "region_idx", "bbox")
    outer = r.groupBy("doc_id", "page_idx", (1000 + F.floor(F.col("region_idx") / 3)).cast("int").alias("region_idx"))
    return r.unionByName(outer.agg(G.union(F.col("bbox")).alias("bbox")))


@query(f"""with {NESTED_SQL}, wraps as (
  select a.doc_id, a.page_idx, a.region_idx, count(*) as children, any_value((a.x1 - a.x0) * (a.y1 - a.y0)) as own,
    sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) as filled
  from nested a join nested b on a.doc_id = b.doc_id and a.page_idx = b.page_idx and a.region_idx <> b.region_idx
    and (b.x1 - b.x0) * (b.y1 - b.y0) < (a.x1 - a.x0) * (a.y1 - a.y0)
    and greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.9
  group by all
)
select doc_id, page_idx, region_idx from nested anti join (select * from wraps where children >= 2 and filled >= 0.6 * own) using (doc_id, page_idx, region_idx)""")
def wrapper_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.without_wrappers(nested(spark, sf_dir)).select("doc_id", "page_idx", "region_idx")


@query(f"""with recursive {NESTED_SQL}, o as (
  select doc_id, page_idx, struct_pack(region_idx := region_idx, x0 := x0, y0 := y0, x1 := x1, y1 := y1) as r, row_number() over (partition by doc_id, page_idx order by region_idx) as k from nested
), z as (
  select doc_id, page_idx, k, [r] as kept from o where k = 1
  union all
  select o.doc_id, o.page_idx, o.k, case when len(list_filter(z.kept, lambda q:
      greatest(0, least(q.x1, o.r.x1) - greatest(q.x0, o.r.x0)) * greatest(0, least(q.y1, o.r.y1) - greatest(q.y0, o.r.y0))
      >= 0.9::double * greatest((q.x1 - q.x0) * (q.y1 - q.y0), (o.r.x1 - o.r.x0) * (o.r.y1 - o.r.y0)))) > 0 then z.kept else list_append(z.kept, o.r) end
  from z join o on z.doc_id = o.doc_id and z.page_idx = o.page_idx and o.k = z.k + 1
)
select doc_id, page_idx, r.region_idx as region_idx from (
  select doc_id, page_idx, unnest(kept) as r from z qualify row_number() over (partition by doc_id, page_idx order by k desc) = 1)""")
def duplicate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.without_duplicates(nested(spark, sf_dir)).select("doc_id", "page_idx", "region_idx")


@query(f"""with recursive {LINES_SQL}, o as (
  select doc_id, page_idx, n, x0 + 40 * (n % 9) as x0, y0 - 10 * (n % 9) as y0, x1 + 40 * (n % 9) as x1, y1 - 10 * (n % 9) as y1 from lines
), w as (select *, row_number() over (partition by doc_id, page_idx order by y0, x0, n) as k from o
), z as (
  select doc_id, page_idx, k, [struct_pack(members := [n], x0 := x0, y0 := y0, x1 := x1, y1 := y1)] as groups from w where k = 1
  union all
  select doc_id, page_idx, k, case when hit is null then list_append(groups, struct_pack(members := [n], x0 := x0, y0 := y0, x1 := x1, y1 := y1))
    else list_transform(groups, lambda q, i: case when i = hit then struct_pack(members := list_append(q.members, n), x0 := least(q.x0, x0), y0 := least(q.y0, y0), x1 := greatest(q.x1, x1), y1 := greatest(q.y1, y1)) else q end) end
  from (select w.*, z.groups, list_max(list_filter(list_transform(z.groups, lambda q, i: case
      when least(q.y1, w.y1) - greatest(q.y0, w.y0) >= 0.65::double * least(q.y1 - q.y0, w.y1 - w.y0) and greatest(q.x0, w.x0) - least(q.x1, w.x1) <= 0.03::double * {PAGE_WIDTH}::double then i end), lambda i: i is not null)) as hit
    from z join w on z.doc_id = w.doc_id and z.page_idx = w.page_idx and w.k = z.k + 1)
)
select doc_id, page_idx, array_to_string(list_sort(g.members), ',') as members, g.x0 as x0, g.y0 as y0, g.x1 as x1, g.y1 as y1 from (
  select doc_id, page_idx, unnest(groups) as g from z qualify row_number() over (partition by doc_id, page_idx order by k desc) = 1)""")
def merged_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = blocks(spark, sf_dir)
    b = F.col("bbox")
    side = few.withColumn("bbox", G.box(b["x0"] + 40 * (F.col("n") % 9), b["y0"] - 10 * (F.col("n") % 9), b["x1"] + 40 * (F.col("n") % 9), b["y1"] - 10 * (F.col("n") % 9)))
    out = R.merged_headings(side, PAGE_WIDTH)
    return out.select("doc_id", "page_idx", F.array_join(F.array_sort("members").cast("array<string>"), ",").alias("members"), "bbox.*")


@query(f"""with {LINES_SQL}, kinds as (
  select doc_id, page_idx, n, case when n % 4 = 0 then 'image' when n % 4 = 1 and page_idx % 2 = 0 then 'text' else 'page_header' end as kind from lines
)
select doc_id, page_idx from kinds group by all
having bool_or(kind = 'image') and not bool_or(kind = 'text')""")
def preserved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("n") % 4 == 0, "Image Body").when((F.col("n") % 4 == 1) & (F.col("page_idx") % 2 == 0), "content").otherwise("Header")
    return S.preserved_pages(blocks(spark, sf_dir).withColumn("type", kind))


@query(f"""with {LINES_SQL}, k as (
  select doc_id, page_idx, n, ['text', 'page_header', 'equation', 'image', 'table_text', 'made_up'][n % 6 + 1] as kind, n % 17 = 0 as broken from lines
), p as (select doc_id, page_idx, page_idx % 3 = 2 as preserved from k group by all)
select case when broken then 'malformed' when preserved then 'visual_page' when kind = 'page_header' then 'furniture'
  when kind = 'equation' then 'formula' when kind in ('image', 'table_text') then 'visual_or_table' else 'source' end as disposition, count(*) as n
from k join p using (doc_id, page_idx) group by all""")
def block_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Paragraph", "header", "Formula", "figure", "table-text", "Made up"))), (F.col("n") % 6 + 1).cast("int"))
    bbox = F.when(F.col("n") % 17 != 0, F.col("bbox"))
    b = blocks(spark, sf_dir).select(S.disposition(S.canonical(kind), bbox, F.col("page_idx") % 3 == 2).alias("disposition"))
    return b.groupBy("disposition").agg(F.count("*").alias("n"))


@query(f"""with {LINES_SQL}, b as (select *, ['text', 'image', 'page_header'][n % 3 + 1] as kind from lines)
select doc_id, page_idx, type, x0, y0, x1, y1 from (select doc_id, page_idx, case type when 'paragraph_title' then 'section_heading' else type end as type, x0, y0, x1, y1 from regions)
union all
select doc_id, page_idx, kind, x0, y0, x1, y1 from b where (doc_id, page_idx, kind) not in (select (doc_id, page_idx, type) from regions)""")
def region_block_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    kind = F.element_at(F.array(F.lit("text"), F.lit("figure"), F.lit("header")), (F.col("n") % 3 + 1).cast("int"))
    return _flat(S.with_fallback(regions(b), b.withColumn("type", kind)), "doc_id", "page_idx", "type")


@query(f"""with {LINES_SQL}, v as (select *, y0 + (n * 7) % 23 as a, y0 + (n * 7) % 23 + 5 + n % 9 as b from lines),
f as (select *, a > max(b) over (partition by doc_id, page_idx order by a, b, n rows between unbounded preceding and 1 preceding) + 1 as fresh from v),
i as (select *, sum(coalesce(fresh, true)::int) over (partition by doc_id, page_idx order by a, b, n) - 1 as island from f)
select doc_id, page_idx, island::int as island, min(a) as top, max(b) as bottom, count(*) as members from i group by all""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("bbox.y0") + (F.col("n") * 7) % 23
    v = blocks(spark, sf_dir).select("doc_id", "page_idx", "n", a.alias("a"), (a + 5 + F.col("n") % 9).alias("b"))
    merged = R.islands(v, ["doc_id", "page_idx"], "n", F.col("a"), F.col("b"), slack=1.0)
    return merged.groupBy("doc_id", "page_idx", "island").agg(F.min("a").alias("top"), F.max("b").alias("bottom"), F.count("*").alias("members"))


@query(f"""with {LINES_SQL}, m as (select doc_id, page_idx, region_idx, min(y0) as a, max(y1) as b from lines join (select doc_id, page_idx, n, (n // 5)::int as region_idx from lines) using (doc_id, page_idx, n) group by all),
f as (select *, a > max(b) over (partition by doc_id, page_idx order by a, b, region_idx rows between unbounded preceding and 1 preceding) as fresh from m),
i as (select *, sum(coalesce(fresh, true)::int) over (partition by doc_id, page_idx order by a, b, region_idx) as island from f),
g as (select doc_id, page_idx, island, min(a) as a, max(b) as b from i group by all)
select doc_id, page_idx, coalesce(lag(b) over (partition by doc_id, page_idx order by a), 0) as top, a as bottom from g
qualify bottom > top
union all
select doc_id, page_idx, max(b), {PAGE_HEIGHT}::double from g group by all having max(b) < {PAGE_HEIGHT}""")
def free_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = blocks(spark, sf_dir).groupBy("doc_id", "page_idx", F.floor(F.col("n") / 5).cast("int").alias("region_idx"))
    v = v.agg(F.min("bbox.y0").alias("a"), F.max("bbox.y1").alias("b"))
    merged = R.islands(v, ["doc_id", "page_idx"], "region_idx", F.col("a"), F.col("b"))
    spans = merged.groupBy("doc_id", "page_idx", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return R.free_bands(spans, ["doc_id", "page_idx"], "a", "b", PAGE_HEIGHT)


@query(f"""with {LINES_SQL}, c as (select *, (x0 + x1) / 2 as centre from lines),
f as (select *, centre - lag(centre) over (partition by doc_id, page_idx order by centre, n) > 16 as fresh from c),
i as (select *, sum(coalesce(fresh, true)::int) over (partition by doc_id, page_idx order by centre, n) - 1 as cluster from f)
select doc_id, page_idx, cluster::int as cluster, count(*) as members, min(centre) as first_centre, max(centre) as last_centre from i group by all""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = blocks(spark, sf_dir).select("doc_id", "page_idx", "n", G.center_x(F.col("bbox")).alias("centre"))
    out = R.gap_clusters(c, ["doc_id", "page_idx"], "n", F.col("centre"), 16.0)
    return out.groupBy("doc_id", "page_idx", "cluster").agg(F.count("*").alias("members"), F.min("centre").alias("first_centre"), F.max("centre").alias("last_centre"))


@query(f"""with {LINES_SQL}, cov as (
  select l.doc_id, l.page_idx, l.n, greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)) / ((l.x1 - l.x0) * (l.y1 - l.y0)) as c, r.type as k
  from lines l join regions r using (doc_id, page_idx)
)
select doc_id, page_idx, n from lines anti join (select * from cov where k = 'paragraph_title' and c >= 0.95 or k = 'table' and c >= 0.5) using (doc_id, page_idx, n)""")
def immovable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    r = regions(b)
    return R.owned_text(b, r.where("type = 'paragraph_title'"), r.where("type = 'table'")).select("doc_id", "page_idx", "n")


@query(f"""with {LINES_SQL}
select doc_id, n, round(greatest(0, least(500, x0 * 500 / 612.0)), 6) as x0, round(greatest(0, least(700, y0 * 700 / 552.0)), 6) as y0,
  round(greatest(0, least(500, x1 * 500 / 612.0)), 6) as x1, round(greatest(0, least(700, y1 * 700 / 552.0)), 6) as y1 from lines
where least(500, x1 * 500 / 612.0) > x0 * 500 / 612.0""")
def visual_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = G.pair(F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))
    target = G.box(F.lit(0.0), F.lit(0.0), F.lit(500.0), F.lit(700.0))
    mapped = blocks(spark, sf_dir).select("doc_id", "n", G.to_visual(F.col("bbox"), page, target).alias("bbox")).where("bbox is not null")
    return mapped.select("doc_id", "n", *[F.round(f"bbox.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""with {LINES_SQL}, t as (select *, (page_idx + n) % 4 * 90 as angle from lines)
select doc_id, n, angle::int as angle,
  case angle when 0 then x0 when 90 then y0 when 180 then 612 - x1 else 612 - y1 end as x0,
  case angle when 0 then y0 when 90 then 552 - x1 when 180 then 552 - y1 else x0 end as y0,
  case angle when 0 then x1 when 90 then y1 when 180 then 612 - x0 else 612 - y0 end as x1,
  case angle when 0 then y1 when 90 then 552 - x0 when 180 then 552 - y0 else x1 end as y1, true as returns
from t""")
def rotated_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = G.pair(F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))
    angle = ((F.col("page_idx") + F.col("n")) % 4 * 90).cast("int")
    turned = blocks(spark, sf_dir).select("doc_id", "n", angle.alias("angle"), F.col("bbox").alias("was"))
    turned = turned.withColumn("bbox", G.visual_to_unrotated(F.col("was"), page, F.col("angle")))
    back = G.unrotated_to_visual(F.col("bbox"), page, F.col("angle"))
    return _flat(turned.withColumn("returns", back == F.col("was")), "doc_id", "n", "angle", "returns")


@query(f"""with {LINES_SQL}, u as (select doc_id, page_idx, n, text, type, y0, x0, case when n % 11 = 3 then 0 when n % 11 = 7 then 2 else 1 end as rank from lines)
select doc_id, n, (row_number() over (partition by doc_id order by page_idx, y0, x0, rank, n) - 1)::int as position from u""")
def lines_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("n") % 11 == 3, 0).when(F.col("n") % 11 == 7, 2).otherwise(1)
    w = Window.partitionBy("doc_id").orderBy("page_idx", "bbox.y0", "bbox.x0", rank, "n")
    return blocks(spark, sf_dir).select("doc_id", "n", (F.row_number().over(w) - 1).alias("position"))
