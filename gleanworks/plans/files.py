"""Queries over file listings: duplicates, index, look-ups, orphans, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.operators import catalog, dedup
from gleanworks.session import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: the path is the padded id, the size is the length, the content is the text."""
    docs = table(spark, folder, "documents")
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("path"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "image_index").distinct()


def shared_size_candidates(spark, folder):
    return dedup.shared_size(_texts(spark, folder)).select("path", "size")


def exact_duplicates(spark, folder):
    return dedup.exact_duplicates(_texts(spark, folder))


def duplicate_report(spark, folder):
    return dedup.duplicate_report(exact_duplicates(spark, folder))


def keep_largest(spark, folder):
    members = _index(spark, folder).select(F.regexp_extract("rel", "^(photos/[^/]+)/", 1).alias("group_id"), F.col("rel").alias("path"), "size")
    return catalog.keep_default(members.filter("group_id != ''"))


def _signs(spark, folder):
    """Signs of every vector, and of a damaged copy of it in which one to five neighbouring signs are turned."""
    rows = table(spark, folder, "embeddings").select("vec_id", dedup.sign_bits("embedding").alias("s"))
    return rows.unionByName(rows.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.expr("s ^ shiftleft(shiftleft(1L, int(vec_id % 5 + 1)) - 1L, int(vec_id % 59))").alias("s")))


def near_duplicate_pairs(spark, folder):
    return dedup.near_pairs(_signs(spark, folder), "vec_id", "s", 6)


def near_duplicate_groups(spark, folder):
    return dedup.near_duplicate_groups(_signs(spark, folder), "vec_id", "s", 6)


def images_by_suffix(spark, folder):
    return catalog.with_suffix(_index(spark, folder), catalog.IMAGES, "rel").select("rel", catalog.suffix("rel").alias("suffix"))


def excluded_paths(spark, folder):
    return catalog.not_excluded(_index(spark, folder), ["photos/2009", "photos/2010/"], "rel").select("rel")


def first_root_wins(spark, folder):
    rows = _index(spark, folder).filter("size is not null").select("rel", "size")
    other = rows.filter("size % 3 = 0").select("rel", (F.col("size") + 1).alias("size"), F.lit(0).alias("root_no"))
    return catalog.first_root_wins(rows.groupBy("rel").agg(F.max("size").alias("size")).withColumn("root_no", F.lit(1)).unionByName(other.distinct())).filter("true").groupBy("rel", "root_no").agg(F.max("size").alias("size"))


def index_incremental(spark, folder):
    scan = _index(spark, folder).groupBy("rel").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    old = _index(spark, folder).filter("length(rel) % 2 = 0").select("rel", F.expr("if(size % 5 = 0, size + 1, size)").alias("size"), F.expr("if(size % 7 = 0, mtime + 1D, mtime)").alias("mtime"), "sha256")
    old = old.groupBy("rel").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"), F.max("sha256").alias("sha256"))
    return catalog.refresh_index(scan, old)


def known_hash_lookup(spark, folder):
    """Every file of the index, and whether a file that a review kept has its content."""
    index = _index(spark, folder)
    kept = table(spark, folder, "review_server").select(F.explode("kept").alias("rel")).distinct()
    library = index.join(kept, "rel", "left_semi")
    fresh = index.select("rel", "sha256").distinct()
    known = catalog.known_content(fresh, library).withColumn("known", F.lit(True))
    return known.unionByName(catalog.known_content(fresh, library, known=False).withColumn("known", F.lit(False))).select("rel", "sha256", "known")


def hash_places(spark, folder):
    return catalog.places_of(_index(spark, folder)).filter("copies > 1")


def orphans(spark, folder):
    """Reviewed paths that the index does not have (gone files)."""
    paths = table(spark, folder, "review_server").select(F.explode("paths").alias("rel")).distinct()
    return catalog.orphans(paths, _index(spark, folder))


def review_decisions(spark, folder):
    groups = table(spark, folder, "review_server").groupBy("review_id").agg(F.max("paths").alias("paths"), F.max(F.lower(F.trim("decision"))).alias("decision"))
    groups = groups.select(F.col("review_id").alias("id"), "paths", "decision")
    inputs = groups.filter("id % 2 = 0").select("id", F.expr("id % 6 = 0").alias("ignored"), F.expr("if(id % 4 = 0, paths, slice(paths, 1, 1))").alias("keep"))
    return catalog.merge_decisions(groups, inputs).select("id", "decision", F.array_join("to_move", ";").alias("to_move"))


def review_page(spark, folder):
    groups = table(spark, folder, "review_server").filter("decision = 'pending'").select("group_id").distinct()
    return catalog.page_of(groups, ["group_id"], 2, 20)


def move_plan(spark, folder):
    """Every file moved to one folder under the name of its series, where files with numbers of nations lie already."""
    files = _index(spark, folder).select(F.col("rel").alias("path"), F.regexp_extract("rel", "([^/_]+)_[^/]*$", 1).alias("stem"), catalog.suffix("rel").alias("ext")).distinct()
    lying = table(spark, folder, "nation").select(F.explode(F.array(F.concat(F.lit("IMG-"), "n_nationkey", F.lit(".jpg")), F.concat(F.lit("scan-"), F.col("n_nationkey") * 3, F.lit(".png")))).alias("name"))
    lying = lying.unionByName(spark.createDataFrame([("IMG.jpg",), ("DSC.heic",), ("DSC-02.heic",)], "name string"))
    return catalog.move_names(files.select("path", F.concat_ws(".", "stem", "ext").alias("name")), lying)


QUERIES = {
    f.__name__: f
    for f in (
        shared_size_candidates, exact_duplicates, duplicate_report, keep_largest, near_duplicate_pairs, near_duplicate_groups, images_by_suffix, excluded_paths,
        first_root_wins, index_incremental, known_hash_lookup, hash_places, orphans, review_decisions, review_page, move_plan,
    )
}

_FILES = "files as (select lpad(cast(doc_id as varchar), 10, '0') as path, n_chars as size, text as content from documents)"
_HASHED = f"""with {_FILES},
hashed as (select distinct sha256(content) as hash, size, path from files
           where content is not null and size in (select size from files where content is not null group by size having count(*) > 1)),
found as (select hash, size, path, min(path) over (partition by hash) as group_id, count(*) over (partition by hash) as members from hashed)
"""
# the i-th of 64 signs is bit 64 - i; of the copy, bits vec_id % 59 to vec_id % 59 + vec_id % 5 are turned
_BITS = """s as (select vec_id, list_transform(embedding, lambda v: v > 0) as b from embeddings
  union all select vec_id + 1000000, list_transform(embedding, lambda v, i: (v > 0) <> (64 - i between vec_id % 59 and vec_id % 59 + vec_id % 5)) from embeddings)"""
_NEAR = f"""with recursive {_BITS},
near as (select x.vec_id as a, y.vec_id as b, cast(len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) as int) as distance
         from s x join s y on x.vec_id < y.vec_id),
pairs as (select * from near where distance <= 6)"""
_SUFFIX = r"lower(regexp_extract(rel, '[^/]\.([^./]+)$', 1))"
_INDEX = "idx as (select distinct * from image_index)"

SQL = {
    "shared_size_candidates": f"with {_FILES} select path, size from files where size in (select size from files group by size having count(*) > 1)",
    "exact_duplicates": _HASHED + "select hash, size, path, group_id, members from found where members > 1",
    "duplicate_report": _HASHED + "select count(distinct group_id) as group_count, count(*) - count(distinct group_id) as redundant_files from found where members > 1",
    "keep_largest": rf"""with {_INDEX}, m as (select regexp_extract(rel, '^(photos/[^/]+)/', 1) as group_id, rel as path, coalesce(size, -1) as size from idx)
        select group_id, path, size from (select *, row_number() over (partition by group_id order by size desc, path) as k from m where group_id <> '') where k = 1""",
    "near_duplicate_pairs": _NEAR + " select a, b, distance from pairs",
    "near_duplicate_groups": _NEAR
    + """, both_ways as (select a, b from pairs union all select b, a from pairs),
      walk as (select a as node, a as reached from both_ways union select w.node, e.b from walk w join both_ways e on w.reached = e.a),
      label as (select node, min(reached) as group_id from walk group by node)
      select node as path, group_id, count(*) over (partition by group_id) as members from label""",
    "images_by_suffix": f"with {_INDEX} select rel, {_SUFFIX} as suffix from idx where {_SUFFIX} in {catalog.IMAGES}",
    "excluded_paths": f"with {_INDEX} select rel from idx where not (rel = 'photos/2009' or rel like 'photos/2009/%' or rel = 'photos/2010' or rel like 'photos/2010/%')",
    "first_root_wins": f"""with {_INDEX}, r as (select rel, max(size) as size, 1 as root_no from idx where size is not null group by rel
        union all select rel, size + 1, 0 from idx where size % 3 = 0),
        f as (select rel, min(root_no) as root_no from r group by rel)
        select rel, root_no, max(size) as size from r join f using (rel, root_no) group by rel, root_no""",
    "index_incremental": f"""with {_INDEX}, scan as (select rel, max(size) as size, max(mtime) as mtime from idx group by rel),
        old as (select rel, max(if(size % 5 = 0, size + 1, size)) as size, max(if(size % 7 = 0, mtime + 1, mtime)) as mtime, max(sha256) as sha256
                from idx where length(rel) % 2 = 0 group by rel),
        j as (select s.*, o.sha256 as h, coalesce(s.size = o.size and abs(s.mtime - o.mtime) < 1e-6 and o.sha256 is not null, false) as same from scan s left join old o using (rel))
        select rel, size, mtime, case when same then h end as sha256, not same as to_hash from j""",
    "known_hash_lookup": f"""with {_INDEX}, k as (select distinct unnest(kept) as rel from review_server), l as (select distinct sha256 from idx where sha256 is not null and rel in (select rel from k where rel is not null))
        select rel, sha256, sha256 is not null and sha256 in (select sha256 from l) as known from (select distinct rel, sha256 from idx)""",
    "hash_places": f"with {_INDEX}, r as (select distinct sha256, rel from idx where sha256 is not null), c as (select *, count(*) over (partition by sha256) as copies from r) select sha256, rel, copies from c where copies > 1",
    "orphans": "with p as (select distinct unnest(paths) as rel from review_server) select rel from p where rel is not null and not exists (select 1 from image_index i where i.rel = p.rel)",
    "review_decisions": """with g as (select review_id as id, max(paths) as paths, max(lower(trim(decision, ' '))) as decision from review_server group by review_id),
        i as (select id, id % 6 = 0 as ignored, case when id % 4 = 0 then paths else paths[1:1] end as keep from g where id % 2 = 0),
        j as (select g.*, i.ignored, i.keep, g.decision = 'pending' and coalesce(i.ignored or i.keep is not null, false) as asked,
              list_distinct(list_filter(g.paths, lambda p: not list_contains(i.keep, p))) as rest from g left join i using (id)),
        d as (select *, case when ignored then 'skipped' when len(rest) = 0 then 'kept_all' else 'reviewed' end as new from j)
        select id, case when asked then new else decision end as decision,
               case when asked and new = 'reviewed' then (select string_agg(p, ';' order by k) from (select p, min(k) as k from (select unnest(paths) as p, generate_subscripts(paths, 1) as k) group by p) where not list_contains(keep, p)) end as to_move from d""",
    "review_page": """with g as (select distinct group_id from review_server where decision = 'pending'), k as (select group_id, row_number() over (order by group_id) as k, count(*) over () as n from g)
        select group_id from k where (k - 1) // 20 = least(2, (n + 19) // 20 - 1)""",
    # the k-th file of a name gets the k-th of the numbers 1, 2, 3, ... that no lying file has
    "move_plan": r"""with f as (select distinct rel as path, concat_ws('.', regexp_extract(rel, '([^/_]+)_[^/]*$', 1), lower(regexp_extract(rel, '[^/]\.([^./]+)$', 1))) as name from image_index),
        m as (select *, row_number() over (partition by name order by path) as k from f where path is not null),
        lying as (select 'IMG-' || n_nationkey || '.jpg' as name from nation union select 'scan-' || n_nationkey * 3 || '.png' from nation union select * from (values ('IMG.jpg'), ('DSC.heic'), ('DSC-02.heic'))),
        called as (select name, n, case when n = 1 then name else regexp_extract(name, '^(.*)\.', 1) || '-' || n || '.' || regexp_extract(name, '\.([^.]*)$', 1) end as new_name
                   from (select name, unnest(range(1, count(*) + 60)) as n from m group by name)),
        free as (select *, row_number() over (partition by name order by n) as k from called where new_name not in (select name from lying))
        select m.path, m.name, free.new_name from m join free using (name, k)""",
}
