"""Registered queries of the duplicate-analytics operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinfold.common import cut, scratch, ship, table
from twinfold.functions import media, photo, text
from twinfold.functions.bits import dhash_ring, hex16
from twinfold.functions.names import copy_marker_score, normalize, stem
from twinfold.functions.video import sample_positions
from twinfold.operators import actions, exact, filters, groups, names, perceptual, scan, select, stats
from twinfold.operators.components import components
from twinfold.operators.positions import placed
from twinfold.options import EXACT, IMAGE, NAME, VIDEO, ScanOptions
from twinfold.plans import engine
from twinfold.sources import bindings, containers, content, filewalk, session

#: Thresholds at which the driver's tables hold links; the defaults hold none there.
NAME_THRESHOLD, HASH_BITS, FRAME_BITS, BLUR = 0.6, 17, 3, 15_000.0
INCLUDE, EXCLUDE = (".txt", ".jpg"), (".jpg",)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
    return f


def _double(c: Column) -> Column:
    return F.floor(c * 1_000_000 + 0.5).cast("long")


# Scans and filters


@query
def scan_filter_size(spark, d):
    return bindings.documents(spark, d).filter(scan.size_between(500, 5_000)).select("file_id", "length")


@query
def scan_filter_ext_include_exclude(spark, d):
    return bindings.documents(spark, d).filter(scan.extension_allowed(INCLUDE, EXCLUDE)).select("file_id", "extension")


@query
def scan_exclude_folder(spark, d):
    return bindings.documents(spark, d).filter(scan.outside(("/SRC1/", "/src2/en"))).select("file_id", "directory_name")


@query
def scan_root_distinct(spark, d):
    files = bindings.documents(spark, d)
    nested = files.filter(F.lower("directory_name").startswith("/src3/"))
    return scan.once(files.unionByName(nested)).groupBy("directory_name").agg(F.count("*").alias("n_files"))


@query
def file_projection(spark, d):
    return bindings.documents(spark, d).select("file_id", "file_name", "directory_name", "extension", stem(F.col("file_name")).alias("stem"))


@query
def media_classes(spark, d):
    return bindings.documents(spark, d).groupBy(media.media_class(F.col("extension")).alias("category")).agg(F.count("*").alias("n_files"))


@query
def category_presets(spark, d):
    wanted = media.extensions_of(["Documents", "Videos"], "jpg;.xyz")
    return bindings.documents(spark, d).filter(scan.extension_allowed(tuple(wanted))).groupBy("extension").agg(F.count("*").alias("n_files"))


# Exact content


@query
def size_buckets(spark, d):
    return bindings.documents(spark, d).groupBy("length").agg(F.count("*").alias("n_files")).filter("n_files > 1")


@query
def quick_hash_candidates(spark, d):
    rows = exact.repeated(bindings.documents(spark, d), ["length"])
    rows = rows.withColumn("quick", exact.quick_key(F.col("content"), F.length("content"), 64))
    return exact.repeated(rows, ["length", "quick"]).select("file_id", "length", "quick")


@query
def content_signature(spark, d):
    return exact.hashed(bindings.documents(spark, d)).select("file_id", F.col("group_key").alias("signature"))


@query
def exact_groups(spark, d):
    return exact.groups(exact.hashed(bindings.documents(spark, d)))


@query
def exact_members(spark, d):
    members, _ = exact.detect(exact.hashed(bindings.documents(spark, d)))
    return members.select(F.col("group_key").alias("signature"), "pos", "file_id")


# Names


@query
def name_normalize(spark, d):
    docs = bindings.documents(spark, d).select("file_id", normalize(stem(F.col("file_name"))).alias("normalized_name"))
    return docs.unionByName(bindings.parts(spark, d).select((-F.col("file_id")).alias("file_id"), normalize(stem(F.col("file_name"))).alias("normalized_name")))


def _part_names(spark, d):
    return cut(names.distinct_names(names.normalized(bindings.parts(spark, d))))


@query
def name_pairs(spark, d):
    return names.pairs(_part_names(spark, d), NAME_THRESHOLD).select("a", "b", _double(F.col("ratio")).alias("ratio_millionths"))


@query
def name_clusters(spark, d):
    return components(names.pairs(_part_names(spark, d), NAME_THRESHOLD), "a", "b").select(F.col("node").alias("name_id"), F.col("component").alias("cluster_id"))


@query
def name_group_similarity(spark, d):
    members, reasons = names.detect(bindings.parts(spark, d), NAME_THRESHOLD)
    sizes = members.groupBy("group_key").agg(F.count("*").alias("n_files"), F.min("file_id").alias("group_id"))
    return reasons.join(sizes, "group_key").select("group_id", "n_files", "signature", F.round("similarity", 6).alias("similarity"))


# Perceptual hashes


@query
def dhash_embedding(spark, d):
    return bindings.images(spark, d).select("file_id", hex16(F.col("perceptual_hash")).alias("hash"))


def _hashes(spark, d):
    return cut(bindings.images(spark, d).select(F.col("file_id").alias("id"), F.col("perceptual_hash").alias("h")))


@query
def hamming_pairs(spark, d):
    return perceptual.hash_pairs(_hashes(spark, d), HASH_BITS)


@query
def image_clusters(spark, d):
    return perceptual.image_clusters(bindings.images(spark, d), HASH_BITS).select("group_id", "file_id")


@query
def image_group_similarity(spark, d):
    members, reasons = perceptual.detect_images(bindings.images(spark, d), HASH_BITS)
    first = members.filter("pos = 0").select("group_key", F.col("file_id").alias("first_file"))
    sizes = members.groupBy("group_key").agg(F.count("*").alias("n_files"))
    return reasons.join(first, "group_key").join(sizes, "group_key").select("first_file", "n_files", "signature", F.round("similarity", 6).alias("similarity"))


@query
def video_pairs(spark, d):
    return perceptual.frame_pairs(cut(bindings.videos(spark, d).select("file_id", "frame_hashes")), 2).select("a", "b", _double(F.col("share")).alias("share_millionths"))


@query
def video_clusters(spark, d):
    members, reasons = perceptual.detect_videos(cut(bindings.videos(spark, d)), 2)
    return members.join(reasons, "group_key").select("pos", "file_id", "similarity", "signature")


@query
def video_sample_positions(spark, d):
    v = bindings.videos(spark, d)
    at = sample_positions(F.col("length").cast("double") / 1000, 12)
    return v.select("file_id", F.posexplode(at).alias("k", "second"))


# Keep rules


def _by_size(spark, d) -> tuple[DataFrame, DataFrame]:
    """Files, and members of their size groups by time."""
    files = cut(bindings.documents(spark, d).drop("content"))
    rows = exact.repeated(files, ["length"]).select(F.col("length").cast("string").alias("group_key"), "last_write_utc", "file_id")
    return files, placed(rows, F.asc("last_write_utc"), F.asc("file_id"))


def _keep(rule: str) -> Query:
    def run(spark, d):
        files, members = _by_size(spark, d)
        return select.keepers(members, files, rule)

    return run


for _rule in ("newest", "oldest", "largest", "smallest", "shortest_path", "cleanest_name", "first"):
    QUERIES[f"keep_{_rule}"] = (lambda f: lambda spark, d: f(ship(spark), d))(_keep(_rule))


@query
def redundant_files(spark, d):
    files, members = _by_size(spark, d)
    return select.redundant(members, files, "cleanest_name").select("group_key", "file_id")


@query
def copy_marker_scores(spark, d):
    return bindings.documents(spark, d).select("file_id", copy_marker_score(F.col("file_name")).alias("score"))


# Groups of two detectors: exact content, and size as a second opinion


def _merged(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files, members, reasons and measured groups."""
    files, sized = _by_size(spark, d)
    m1, r1 = exact.detect(cut(exact.hashed(bindings.documents(spark, d)).drop("content")))
    r2 = sized.select("group_key").distinct().select("group_key", F.lit("NameSimilarity").alias("method"), F.lit(0.9).alias("similarity"), F.col("group_key").alias("signature"))
    members, reasons = (cut(x) for x in groups.merge(cut(m1.unionByName(sized)), cut(r1.unionByName(r2))))
    return files, members, reasons, cut(groups.measured(members, reasons, files))


MEASURED = ["group_id", "method", "methods", "similarity", "signature", "n_files", "reclaimable_bytes", "total_bytes"]


@query
def merge_by_file_set(spark, d):
    return _merged(spark, d)[3].select(*MEASURED)


@query
def group_methods_bitmask(spark, d):
    g = _merged(spark, d)[3]
    return g.groupBy("methods").agg(F.count("*").alias("n_groups"), F.count_if(F.col("methods").bitwiseAND(NAME) == NAME).alias("with_name"))


@query
def groups_ranked(spark, d):
    return groups.ranked(_merged(spark, d)[3]).select("ordinal", *MEASURED)


@query
def group_ordinals(spark, d):
    g = groups.ranked(_merged(spark, d)[3])
    return g.select("ordinal", "group_id", text.similarity_text(F.col("similarity")).alias("similarity_text"))


@query
def filter_min_count(spark, d):
    return filters.min_count(_merged(spark, d)[3], 3).select("group_id", "n_files")


@query
def filter_text(spark, d):
    files, members, _, g = _merged(spark, d)
    return filters.with_text(g, members, files, "SRC1").select("group_id", "n_files")


@query
def filter_reasons_any(spark, d):
    _, _, reasons, g = _merged(spark, d)
    return filters.with_reasons(g, reasons, {"ExactContent": 1.0, "NameSimilarity": 0.95}).select("group_id", "n_files")


@query
def filter_reasons_all(spark, d):
    _, _, reasons, g = _merged(spark, d)
    return filters.with_reasons(g, reasons, {"ExactContent": 1.0, "NameSimilarity": 0.9}, every=True).select("group_id", "n_files")


@query
def filter_similarity_floor(spark, d):
    _, _, reasons, g = _merged(spark, d)
    return filters.with_reasons(g, reasons, {}, floor=0.95).select("group_id", "n_files")


@query
def group_reasons(spark, d):
    _, members, reasons, g = _merged(spark, d)
    return reasons.join(g.select("group_key", "group_id", "n_files"), "group_key").select("group_id", "n_files", "method", F.col("similarity").alias("reason_similarity"), F.col("signature").alias("reason_signature"))


# Statistics


@query
def scan_summary(spark, d):
    files, _, _, g = _merged(spark, d)
    return stats.scan_summary(files, g)


@query
def file_type_stats(spark, d):
    return stats.file_types(bindings.documents(spark, d))


@query
def file_type_bars(spark, d):
    return stats.file_type_bars(bindings.documents(spark, d))


@query
def method_stats(spark, d):
    return stats.by_method(_merged(spark, d)[3])


@query
def top5_groups(spark, d):
    g = _merged(spark, d)[3]
    return stats.top(g.filter("method = 'ExactContent'")).select("group_id", "reclaimable_bytes")


@query
def import_totals(spark, d):
    return stats.import_totals(_merged(spark, d)[3])


# Photos


def _photos(spark, d):
    rows = bindings.images(spark, d).withColumns({"sharpness": photo.sharpness(F.col("grid"), 8, 8), "brightness": photo.brightness(F.col("grid"))})
    w, h, s, b = (F.col(c) for c in ("width", "height", "sharpness", "brightness"))
    found = photo.flags(s, b, w, h, F.col("file_name"), F.col("extension"), BLUR)
    return rows.withColumn("flags", found).withColumn("score", photo.score(s, b, w, h, F.col("flags")))


@query
def photo_quality(spark, d):
    return _photos(spark, d).select("file_id", "sharpness", "brightness", "score", F.array_join("flags", ",").alias("flags"))


@query
def photo_flags_histogram(spark, d):
    return stats.flag_histogram(_photos(spark, d))


@query
def photo_flagged_only(spark, d):
    return _photos(spark, d).filter(F.size("flags") > 0).select("file_id", "score", text.resolution(F.col("width"), F.col("height")).alias("resolution"))


@query
def photo_texts(spark, d):
    w, h = F.col("width"), F.col("height")
    return bindings.images(spark, d).select("file_id", text.resolution(w, h).alias("resolution"), text.megapixels_text(w, h).alias("megapixels"))


@query
def screenshot_rule(spark, d):
    return bindings.images(spark, d).select("file_id", media.is_screenshot(F.col("file_name"), F.col("extension"), F.col("width"), F.col("height")).alias("screenshot"))


# Texts and sinks


@query
def humanize_bytes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.humanize(F.floor(F.col("o_totalprice")).cast("long") * 1024).alias("size_text"))


@query
def parse_extensions(spark, d):
    made = F.concat(F.upper(F.substring("p_brand", 1, 3)), F.lit(";."), F.substring("p_type", 1, 3), F.lit(", "), F.substring("p_name", 1, 2))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.parse_extensions(F.regexp_replace(made, "[^A-Za-z;., ]", "")), "|").alias("extensions"))


@query
def report_csv_rows(spark, d):
    files, members, _, g = _merged(spark, d)
    rows = session.csv_rows(groups.ranked(g), members, files)
    return rows.select(F.col("GroupId").alias("group_number"), F.col("_pos").alias("pos"), F.col("Method").alias("method"), F.col("Similarity").alias("similarity_text"), text.csv_escape(F.col("FilePath")).alias("file_path"), F.col("SizeBytes").alias("size_bytes"), F.col("ReclaimableBytes").alias("reclaimable_bytes"))


@query
def report_json_rows(spark, d):
    files, members, reasons, g = _merged(spark, d)
    return session.json_groups(groups.ranked(g), members, files, reasons)


@query
def session_roundtrip(spark, d):
    files, members, reasons, g = _merged(spark, d)
    lines = session.session_groups(groups.ranked(g), members, files, reasons)
    one = F.from_json("json", "struct<Reasons: array<struct<Method: string, Similarity: double, Signature: string>>, Files: array<struct<Path: string, Length: bigint, LastWriteUtc: string, ContentHash: string>>>")
    back = session.imported(lines.select(F.array(one).alias("Groups"), "ordinal").select("Groups")).select("reasons", "files")
    return back.select(F.size("files").alias("n_files"), F.size("reasons").alias("n_reasons"), F.get("files", 0)["Path"].alias("first_path"), F.aggregate("files", F.lit(0).cast("bigint"), lambda a, f: a + f["Length"]).alias("total_bytes"))


@query
def session_import_defaults(spark, d):
    """Size groups as sessions without reasons; those of one file go."""
    files = bindings.documents(spark, d).groupBy("length").agg(F.sort_array(F.collect_list(F.struct(F.col("full_path").alias("Path"), F.col("length").alias("Length"), F.lit("").alias("LastWriteUtc"), F.lit("").alias("ContentHash")))).alias("Files"))
    none = F.array().cast("array<struct<Method: string, Similarity: double, Signature: string>>")
    back = session.imported(files.select(F.array(F.struct(none.alias("Reasons"), "Files")).alias("Groups")))
    r = F.get("reasons", 0)
    return back.select(F.get("files", 0)["Length"].alias("length"), F.size("files").alias("n_files"), r["Method"].alias("method"), r["Similarity"].alias("similarity"))


@query
def action_plan_move(spark, d):
    """Names are made to meet: of each twenty folders' items one name."""
    files, members = _by_size(spark, d)
    gone = select.redundant(members, files, "first").select("file_id")
    named = files.withColumn("file_name", F.regexp_replace("file_name", r"^item \d+", F.concat(F.lit("item "), (F.col("file_id") % 20).cast("string"), F.when(F.col("file_id") % 3 == 0, F.concat(F.lit(" ("), (F.col("file_id") % 4).cast("string"), F.lit(")"))).otherwise(""))))
    return actions.plan_move(named.join(gone, "file_id", "left_semi"), "/trash/", spark.createDataFrame([("ITEM 3.txt",), ("item 7 (2).txt",)], "file_name string"))


@query
def action_plan_delete(spark, d):
    files, members = _by_size(spark, d)
    gone = select.redundant(members, files, "first").select("file_id")
    return actions.plan_delete(files.join(gone, "file_id", "left_semi"))


@query
def after_action_groups(spark, d):
    files, members = _by_size(spark, d)
    gone = files.filter("file_id % 3 = 0").select(F.upper("full_path").alias("path"))
    return actions.after(members, files, gone).groupBy("group_key").agg(F.count("*").alias("n_files"))


@query
def action_report(spark, d):
    rows = bindings.documents(spark, d).select(F.col("full_path").alias("path"), F.col("length").alias("bytes"), F.when(F.col("file_id") % 100 == 0, F.lit("denied")).alias("error"))
    return actions.report(rows)


@query
def action_errors(spark, d):
    rows = bindings.documents(spark, d).select(F.col("full_path").alias("path"), F.col("length").alias("bytes"), F.when(F.col("file_id") % 100 == 0, F.lit("denied")).alias("error"))
    return actions.errors(rows)


# Lists and counts as they are shown


@query
def photos_by_score(spark, d):
    return groups.numbered(_photos(spark, d).select("file_id", "score"), F.asc("score"), F.asc("file_id"))


@query
def reasons_by_similarity(spark, d):
    _, _, reasons, g = _merged(spark, d)
    return groups.reasons_shown(reasons).join(g.select("group_key", "group_id", "n_files"), "group_key").select("group_id", "n_files", "place", "method", "similarity")


@query
def groups_by_column(spark, d):
    return groups.sorted_by(_merged(spark, d)[3].select("group_id", "n_files", "total_bytes"), "total_bytes", True).select("ordinal", "total_bytes")


@query
def files_by_name(spark, d):
    return groups.sorted_by(bindings.documents(spark, d).select("file_id", "file_name"), "file_name", key="file_id")


@query
def photo_counts(spark, d):
    return stats.photo_counts(_photos(spark, d))


@query
def selection_totals(spark, d):
    files, members = _by_size(spark, d)
    return stats.selection(files, select.redundant(members, files, "newest"))


@query
def candidate_bytes(spark, d):
    return stats.candidates(bindings.documents(spark, d))


@query
def visible_groups(spark, d):
    return groups.visible(_merged(spark, d)[3], F.col("n_files") >= 3)


@query
def engine_scan(spark, d):
    """The whole engine: all four detectors over one set of documents, images and videos."""
    out = engine.run(spark, bindings.everything(spark, d), ScanOptions(methods=EXACT | NAME | IMAGE | VIDEO, perceptual_threshold=2))
    return out.groups.select("ordinal", "group_id", "method", "n_files", "reclaimable_bytes", "total_bytes")


# A tree of files, written from documents and walked again


def _tree(spark, d) -> tuple[str, DataFrame]:
    """The root of a tree with a file for each document, some of them hidden or in hidden or deep folders, and the rows it was made of."""
    key = F.col("doc_id")
    folder = F.concat(F.lit("s"), (key % 5).cast("string"), F.when(key % 7 == 0, "/.hid").otherwise(""), F.when(key % 3 == 0, "/deep/er").otherwise(""))
    path = F.concat(folder, F.when(key % 11 == 0, "/.").otherwise("/"), F.lit("f"), key.cast("string"), F.when(key % 2 == 0, ".TXT").otherwise(".md"))
    rows = table(spark, d, "documents").filter("doc_id is not null").select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    root = scratch(spark, "tree")
    content.write_files(rows, root)
    return root, rows


def _walked(spark, d, **options) -> tuple[DataFrame, DataFrame, str]:
    root, _ = _tree(spark, d)
    files, warnings = filewalk.scan(spark, ScanOptions(roots=(root, f"{root}/missing"), **{k: tuple(f"{root}/{x}" for x in v) if k == "excluded_folders" else v for k, v in options.items()}))
    return files.withColumn("path", F.expr(f"substring(full_path, {len(root) + 2})")), warnings, root


@query
def tree_walk(spark, d):
    """Hidden files and folders stay out, one folder is excluded."""
    return _walked(spark, d, excluded_folders=("S1",))[0].select("path", "file_name", "extension", "length")


@query
def tree_walk_hidden(spark, d):
    return _walked(spark, d, include_hidden=True)[0].select("path", "length")


@query
def tree_walk_flat(spark, d):
    """Without recursion only the files of the roots themselves are listed: here, of one folder."""
    root, _ = _tree(spark, d)
    return filewalk.scan(spark, ScanOptions(roots=(f"{root}/s2", f"{root}/S2/"), recursive=False))[0].select("file_name", "length")


@query
def tree_warnings(spark, d):
    """A root that is missing is a warning, not an error."""
    _, warnings, root = _walked(spark, d)
    return warnings.select(F.replace("warning", F.lit(root), F.lit("")).alias("warning"))


def _applied(spark, d) -> tuple[DataFrame, DataFrame, str]:
    """A tree whose copies are deleted, or moved if their number is odd, twice over; files that are not there are asked for as well."""
    files, _, root = _walked(spark, d, include_hidden=True)
    signed, _ = content.hashed(files)
    rest = placed(cut(signed).select("group_key", "path", F.col("full_path").alias("file_id")), F.asc("path")).filter("pos > 0").select(F.col("file_id").alias("full_path"))
    gone = cut(files.join(rest, "full_path", "left_semi").withColumn("number", F.regexp_extract("file_name", r"f(\d+)", 1).try_cast("long")))
    absent = files.filter(F.regexp_extract("file_name", r"f(\d+)", 1).try_cast("long") % 50 == 0).select(F.concat("full_path", F.lit(".gone")).alias("full_path"), "length")
    plan = actions.plan_delete(gone.filter("number % 2 = 0").select("full_path", "length").unionByName(absent)).unionByName(actions.plan_move(gone.filter("number % 2 = 1"), f"{root}/moved"), allowMissingColumns=True)
    at = scratch(spark, "journal")
    actions.apply(plan, at)
    return actions.apply(plan, at), files, root


@query
def action_apply(spark, d):
    """Outcomes of deleting and moving files of a tree, and which of the paths are there when it is walked again."""
    outcomes, _, root = _applied(spark, d)
    left = filewalk.scan(spark, ScanOptions(roots=(root,), include_hidden=True))[0].select(F.col("full_path").alias("path"), F.lit(True).alias("there"))
    both = outcomes.join(left, "path", "left").join(left.select(F.col("path").alias("destination"), F.col("there").alias("arrived")), "destination", "left")
    return both.select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), "action", "error", F.coalesce("there", F.lit(False)).alias("there"), F.coalesce("arrived", F.lit(False)).alias("arrived"))


@query
def action_apply_report(spark, d):
    return actions.report(_applied(spark, d)[0])


@query
def tree_exact_groups(spark, d):
    """Sizes, samples and whole contents, read from the files."""
    files, _, _ = _walked(spark, d, include_hidden=True)
    signed, _ = content.hashed(files)
    return signed.groupBy("group_key").agg(F.count("*").alias("n_files")).filter("n_files > 1")


@query
def tree_video_durations(spark, d):
    """Lengths read from the headers of a tree of videos, one for each document, whose text stands before the header; every third has no header."""
    key, data = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    number = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    size = F.octet_length(data)
    header = F.concat(F.unhex(F.lit("000000246D6F6F760000001C6D766864" + "0" * 24 + "000003E8")), number(size + 1))
    body = F.concat(F.unhex(F.lit("0000000C6674797069736F6D")), number(size + 8), F.lit("mdat").cast("binary"), data, header)
    path = F.concat(F.lit("v"), (key % 5).cast("string"), F.lit("/f"), key.cast("string"), F.when(key % 3 == 2, ".mkv").otherwise(".mp4"))
    root = scratch(spark, "videos")
    content.write_files(table(spark, d, "documents").filter("doc_id is not null").select(path.alias("path"), F.when(key % 3 == 2, data).otherwise(body).alias("content")), root)
    files, _ = filewalk.scan(spark, ScanOptions(roots=(root,)))
    return containers.durations(files).select(F.expr(f"substring(full_path, {len(root) + 2})").alias("path"), "duration")
