"""Catalogue rules, probe documents, boxes, tags, names."""

from pyspark.sql import functions as F

from orbframe.functions import media, naming
from orbframe.plans.lenses import table
from orbframe.plans.media_lens import CATALOGUE, catalogue, movie_files, photo_files, probe_documents
from orbframe.plans.registry import query, r6, rounded
from orbframe.sources import boxes, photosphere, probe, rawframes, stills

C = F.col
IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
EXT = r"lower(regexp_extract(path, '[^/](\.[^./]*)$', 1))"


@query("file_kinds", f"""WITH {CATALOGUE} SELECT path, {EXT} AS ext, {EXT} IN {IN(media.STILL)} AS still, {EXT} IN {IN(media.JPEG)} AS jpeg,
  {EXT} IN {IN(media.WRITABLE_STILL)} AS writable FROM cat""")
def file_kinds(spark, sf):
    return stills.classify(catalogue(spark, sf).select("path"))


@query("frame_totals", f"""WITH {CATALOGUE} SELECT k, CAST(CASE WHEN frames IS NULL THEN 200 ELSE least(greatest(0, frames - 1000), 200) END AS BIGINT) AS total,
  CASE WHEN fps > 0 AND k % 3000 < frames THEN k % 3000 ELSE 0 END AS shown FROM cat""")
def frame_totals(spark, sf):
    """Frames to render from 1000 on, at most 200; and thumbnail frames."""
    c = catalogue(spark, sf).withColumn("wanted", C("k") % 3000)
    shown = rawframes.thumbnail_frames(c, count="frames")
    return shown.select("k", media.frame_total(C("frames"), F.lit(1000), F.lit(200)).cast("bigint").alias("total"), "shown")


LOW = "lower(pix_fmt)"
STEM = f"regexp_replace({LOW}, '(le|be)$', '')"
CHROMA = f"""CASE WHEN {LOW} LIKE 'nv12%' OR {LOW} LIKE 'nv21%' THEN '4:2:0' WHEN {LOW} LIKE 'nv16%' OR {LOW} LIKE 'nv20%' THEN '4:2:2'
  WHEN {LOW} LIKE 'nv24%' OR {LOW} LIKE 'nv42%' THEN '4:4:4' WHEN {LOW} LIKE 'gray%' THEN '4:0:0'
  WHEN regexp_matches({LOW}, '^(gbr|rgb|bgr|argb|abgr|x2rgb|x2bgr)') THEN '4:4:4'
  WHEN regexp_matches({LOW}, '^yuva?j?[0-9]{{3}}') THEN regexp_replace({LOW}, '^yuva?j?([0-9])([0-9])([0-9]).*$', '\\1:\\2:\\3') END"""
DEPTH = f"""CASE WHEN {LOW} LIKE 'p010%' THEN 10 WHEN {LOW} LIKE 'p012%' THEN 12 WHEN {LOW} LIKE 'p016%' THEN 16
  WHEN NOT regexp_matches({LOW}, '^(yuv|gray)') THEN NULL
  WHEN regexp_matches({STEM}, '[0-9]+$') THEN CAST(regexp_extract({STEM}, '([0-9]+)$', 1) AS INT)
  WHEN {STEM} LIKE '%p' OR {STEM} = 'gray' THEN 8 END"""
HW = f"regexp_matches(codec, '_(nvenc|qsv|amf|vaapi|videotoolbox)$')"


@query("pix_fmt", f"""WITH {CATALOGUE}, m AS (SELECT *, {CHROMA} AS chroma, {DEPTH} AS bit_depth, k % 2 = 0 AS follow FROM cat)
SELECT k, pix_fmt, chroma, bit_depth, CASE WHEN {HW} THEN regexp_extract(codec, '_([a-z]+)$', 1) ELSE 'sw' END AS family,
  CASE WHEN follow AND chroma IS NOT NULL AND (chroma = '4:2:0' OR (chroma IN ('4:2:2', '4:4:4') AND NOT {HW})) THEN chroma ELSE '4:2:0' END AS out_chroma,
  CASE WHEN NOT follow THEN 'default' WHEN chroma IS NULL THEN 'unknown_source' WHEN chroma = '4:2:0' OR (chroma IN ('4:2:2', '4:4:4') AND NOT {HW}) THEN 'matches_source' ELSE 'not_encodable' END AS reason,
  CASE WHEN bit_depth > 8 THEN CASE WHEN k % 4 < 2 THEN 'deep_output_8bit_data' ELSE 'reduced_to_8bit' END END AS precision_note FROM m""")
def pix_fmt(spark, sf):
    c = catalogue(spark, sf).withColumns({"chroma": media.chroma(C("pix_fmt")), "bit_depth": media.bit_depth(C("pix_fmt"))})
    out = media.output_chroma(C("chroma"), C("codec"), C("k") % 2 == 0)
    return c.select(
        "k", "pix_fmt", "chroma", "bit_depth", media.encoder_family(C("codec")).alias("family"), out["chroma"].alias("out_chroma"), out["reason"].alias("reason"),
        media.deep_source(C("bit_depth"), F.when(C("k") % 4 < 2, 10).otherwise(8)).alias("precision_note"))


FOV = "CASE WHEN projection IS NOT NULL THEN 360.0 * width / (width + 2 * bound) END"


@query("admission", f"""WITH {CATALOGUE}, m AS (SELECT *, {FOV} AS fov, coalesce(layout NOT IN ('2D', ''), false) AS stereo FROM cat),
v AS (SELECT *, coalesce(fov < 359, false) AS partial, projection IS NULL AND abs(width / greatest(height, 1) - 1.0) < 0.15 AS square FROM m)
SELECT k, round(fov, 6) + 0.0 AS fov, stereo,
  CASE WHEN stereo THEN 'refuse' WHEN NOT (partial OR square) THEN 'accept' WHEN requested <> 'auto' THEN 'warn' ELSE 'refuse' END AS status,
  CASE WHEN stereo THEN 'stereo' WHEN partial THEN 'declared_partial' WHEN square THEN 'square_shape' END AS reason,
  CASE WHEN requested <> 'auto' THEN requested WHEN projection IS NULL THEN 'equirectangular' WHEN projection IN ('equirectangular', 'cubemap') THEN projection END AS using,
  CASE WHEN requested <> 'auto' THEN CASE WHEN projection <> requested THEN 'warn' ELSE 'accept' END
       WHEN projection IS NULL OR projection IN ('equirectangular', 'cubemap') THEN 'accept' ELSE 'refuse' END AS projection_status FROM v""")
def admission(spark, sf):
    c = catalogue(spark, sf).withColumn("fov", media.horizontal_fov(C("projection"), C("width"), C("bound"), C("bound")))
    gate = media.admission(C("width"), C("height"), C("projection"), C("fov"), C("layout"), C("requested"))
    proj = media.resolve_projection(C("projection"), C("requested"))
    return c.select("k", r6("fov").alias("fov"), media.is_stereo(C("layout")).alias("stereo"), gate["status"].alias("status"), gate["reason"].alias("reason"),
                    proj["projection"].alias("using"), proj["status"].alias("projection_status"))


EYE_W = lambda t: f"CASE WHEN out_w IS NULL OR out_w = width THEN {t} WHEN out_w > width OR out_w < 2 THEN NULL ELSE CAST(round_even({t} * (out_w / width), 0) AS INT) // 2 * 2 END"


@query("geometry", f"""WITH {CATALOGUE}, m AS (SELECT *, {EYE_W('width')} AS eye_w, {EYE_W('height')} AS eye_h FROM cat)
SELECT k, CAST(CASE WHEN projection = 'cubemap' THEN width // 3 - 2 * padding ELSE greatest(1, width // 4) END AS INT) AS face_size,
  CAST(CASE WHEN projection = 'cubemap' THEN (width // 3 - 2 * padding) * 4 ELSE width END AS INT) AS pano_w,
  CAST(CASE WHEN projection = 'cubemap' THEN (width // 3 - 2 * padding) * 2 ELSE height END AS INT) AS pano_h,
  CAST(eye_w AS INT) AS eye_w, CAST(eye_h AS INT) AS eye_h,
  CASE WHEN out_w IS NULL OR out_w = width THEN NULL WHEN out_w > width THEN 'upscale' WHEN out_w < 2 THEN 'too_small' END AS error,
  CAST(CASE WHEN mode = 'vr180' THEN eye_w // 2 // 2 * 2 * 2 ELSE eye_w END AS INT) AS out_width, CAST(CASE WHEN mode = 'vr180' THEN eye_h ELSE eye_h * 2 END AS INT) AS out_height,
  CASE WHEN k % 6 = 0 OR mode <> '360' OR width <= 5760 THEN 0 ELSE 5760 END AS default_width, yaw = 0 OR mode = 'vr180' AS yaw_ok,
  CAST(greatest(14, CAST(round_even(CASE WHEN abs(1 - 518.0 / width) < abs(1 - 518.0 / height) THEN 518.0 / width ELSE 518.0 / height END * height / 14, 0) AS INT) * 14) AS INT) AS model_h,
  CAST(greatest(14, CAST(round_even(CASE WHEN abs(1 - 518.0 / width) < abs(1 - 518.0 / height) THEN 518.0 / width ELSE 518.0 / height END * width / 14, 0) AS INT) * 14) AS INT) AS model_w FROM m""")
def geometry(spark, sf):
    c = catalogue(spark, sf).withColumn("eye", media.eye_size(C("width"), C("height"), C("out_w")))
    src = media.source_geometry(C("width"), C("height"), F.coalesce("projection", F.lit("")), C("padding"))
    out = media.output_geometry(C("eye.eye_w"), C("eye.eye_h"), C("mode"))
    model = media.model_size(C("height"), C("width"), 518, 14)
    return c.select(
        "k", src["face_size"].alias("face_size"), src["pano_w"].alias("pano_w"), src["pano_h"].alias("pano_h"), "eye.eye_w", "eye.eye_h", "eye.error",
        out["out_w"].alias("out_width"), out["out_h"].alias("out_height"),
        media.default_output_width(C("width"), C("mode"), C("k") % 6 == 0).alias("default_width"), media.yaw_allowed(C("mode"), C("yaw")).alias("yaw_ok"),
        model["th"].alias("model_h"), model["tw"].alias("model_w"))


@query("resolution_choices", f"""WITH {CATALOGUE},
cw AS (SELECT DISTINCT k, width, height, mode, c FROM (SELECT k, width, height, mode, unnest([width, 7680, 5760, 4096, 3840, 2880, 1920]) AS c FROM cat) WHERE c <= width),
e AS (SELECT *, CASE WHEN c = width THEN width ELSE CAST(round_even(width * (c / width), 0) AS INT) // 2 * 2 END AS ew,
  CASE WHEN c = width THEN height ELSE CAST(round_even(height * (c / width), 0) AS INT) // 2 * 2 END AS eh FROM cw),
o AS (SELECT *, CASE WHEN mode = 'vr180' THEN ew // 2 // 2 * 2 * 2 ELSE ew END AS ow, CASE WHEN mode = 'vr180' THEN eh ELSE eh * 2 END AS oh FROM e)
SELECT k, c AS width, ow AS out_w, oh AS out_h, round_even(CAST(ow AS BIGINT) * oh / 1e6, 1) + 0.0 AS megapixels, CAST(ow AS BIGINT) * oh <= 35651584 AS fits, c = width AS native FROM o""")
def resolution_choices(spark, sf):
    c = catalogue(spark, sf).select("k", F.inline(media.resolution_choices(C("width"), C("height"), C("mode"))))
    return c.withColumn("megapixels", C("megapixels") + F.lit(0.0))


HALF = "(width // 2 // 2 * 2)"


@query("crop", f"""WITH {CATALOGUE}, t AS (SELECT *, yaw + 180.0 - 360.0 * floor((yaw + 180.0) / 360.0) AS turn FROM cat),
r AS (SELECT *, CAST(round_even(turn / 360.0 * width - {HALF} / 2.0, 0) AS INT) AS raw FROM t)
SELECT k, CAST(((raw % width) + width) % width AS INT) AS x0, CAST({HALF} AS INT) AS half,
  CAST(CASE WHEN mode = 'vr180' THEN width // 2 ELSE width END AS INT) AS crop_w, CAST(CASE WHEN mode = 'vr180' THEN height ELSE height // 2 END AS INT) AS crop_h,
  CAST(CASE WHEN mode = 'vr180' THEN width // 2 * 2 ELSE width END AS INT) AS full_w, CAST(CASE WHEN mode = 'vr180' THEN width // 2 // 2 ELSE 0 END AS INT) AS crop_left,
  CAST(CASE WHEN 360.0 - k % 400 > 0 THEN round_even((1.0 - (360.0 - k % 400) / 360.0) / 2.0 * 4294967296.0, 0) END AS BIGINT) AS bounds FROM r""")
def crop(spark, sf):
    x0, half = media.half_field(C("width"), C("yaw"))
    tags = media.eye_tags(C("width"), C("height"), C("mode"))
    return catalogue(spark, sf).select(
        "k", x0.alias("x0"), half.alias("half"), tags["crop_w"].alias("crop_w"), tags["crop_h"].alias("crop_h"), tags["full_w"].alias("full_w"),
        tags["left"].alias("crop_left"), media.sphere_bounds(360.0 - C("k") % 400).alias("bounds"))


NAME_TAILS = ("", "_360_TB", "-sbs", "_OU", "artbook", "_180x180_3dh", "LR")
NAMES = f"""names AS (SELECT page_id, concat(regexp_replace(url, '^[a-z]+://', ''), list_extract([{', '.join(f"'{t}'" for t in NAME_TAILS)}], CAST(page_id % 7 AS INT) + 1),
  CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '.mp4' END) AS path FROM pages)"""


@query("names", rf"""WITH {NAMES}, b AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM names),
x AS (SELECT *, regexp_extract(regexp_replace(base, '^\.+', ''), '.(\.[^.]*)$', 1) AS ext FROM b),
s AS (SELECT *, left(base, length(base) - length(ext)) AS stem, left(path, length(path) - length(ext)) AS front FROM x),
t AS (SELECT *, list_filter(regexp_split_to_array(lower(stem), '[^0-9a-z]+'), lambda x: x <> '') AS tok FROM s),
d AS (SELECT *, list_has_any(tok, ['tb', 'ou', '3dv', 'sbs', 'lr', '3dh']) AS described FROM t)
SELECT page_id, array_to_string(tok, ' ') AS tokens, described,
  CASE WHEN described THEN path ELSE front || CASE WHEN page_id % 3 = 0 THEN '_360_TB' ELSE '_180x180_3dh' END || ext END AS suggested,
  CASE WHEN NOT described THEN stem || CASE WHEN page_id % 3 = 0 THEN '_360_TB' ELSE '_180x180_3dh' END || ext END AS advice FROM d""")
def names(spark, sf):
    """File names made of page addresses with and without packing tokens."""
    tail = F.get(F.array(*[F.lit(t) for t in NAME_TAILS]), (C("page_id") % 7).cast("int"))
    path = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), tail, F.when(C("page_id") % 2 == 0, ".jpg").otherwise(".mp4"))
    n = table(spark, sf, "pages").select("page_id", path.alias("path"))
    mode = F.when(C("page_id") % 3 == 0, "360").otherwise("vr180")
    stem, _ = naming.split_extension(naming.base_name(C("path")))
    return n.select("page_id", F.array_join(naming.tokens(stem), " ").alias("tokens"), naming.describes_stereo(C("path")).alias("described"),
                    naming.suggest(C("path"), mode).alias("suggested"), naming.advice(C("path"), mode).alias("advice"))


ORDER = "CASE channels WHEN 4 THEN 1 WHEN 9 THEN 2 WHEN 16 THEN 3 END"


@query("sound_rules", f"""WITH {CATALOGUE}
SELECT k, round(CASE WHEN audio_s > video_s + 0.25 THEN video_s + CASE WHEN fps > 0 THEN 0.5 / fps ELSE 0.02 END END, 6) + 0.0 AS keep_seconds, {ORDER} AS ambisonic_order,
  CASE WHEN yaw = 0 OR channels IS NULL THEN 'none' WHEN k % 3 <> 0 THEN CASE WHEN {ORDER} IS NOT NULL THEN 'warn_not_flagged' ELSE 'none' END
       WHEN {ORDER} IS NULL THEN 'warn_not_ambix' ELSE 'rotate' END AS turn FROM cat""")
def sound_rules(spark, sf):
    return catalogue(spark, sf).select(
        "k", r6(media.audio_cut(C("video_s"), C("audio_s"), C("fps"))).alias("keep_seconds"), media.ambisonic_order(C("channels")).alias("ambisonic_order"),
        media.sound_turn(C("yaw"), C("channels").isNotNull(), C("channels"), C("k") % 3 == 0).alias("turn"))


@query("probe_json", f"""WITH {CATALOGUE} SELECT k, width, height, fps, CAST(frames AS BIGINT) AS frame_count, video_s AS duration, channels IS NOT NULL AS has_audio, channels AS audio_channels,
  pix_fmt, projection, CASE WHEN projection IS NULL THEN 0 ELSE padding END AS cubemap_padding, CASE WHEN projection IS NULL THEN 0 ELSE bound END AS bound_left,
  layout AS stereo_layout, CASE WHEN k % 3 = 0 THEN 'bt709' END AS space FROM cat""")
def probe_json(spark, sf):
    f = probe.facts(probe_documents(spark, sf))
    return f.withColumn("space", C("color.space")).drop("color", "bound_right")


@query("probe_summary", f"""WITH {CATALOGUE} SELECT k, CAST(width AS VARCHAR) AS width, CAST(frames AS VARCHAR) AS frame_count, CASE WHEN channels IS NOT NULL THEN 'true' ELSE 'false' END AS has_audio,
  {CHROMA} AS chroma, CASE WHEN k % 3 = 0 THEN 'bt709' END AS color_space FROM cat""")
def probe_summary(spark, sf):
    """The one-line JSON summary, with a few fields read back out of it."""
    text = probe.summary(probe.facts(probe_documents(spark, sf)), "k")
    at = lambda n: F.get_json_object("json", f"$.{n}").alias(n)
    return text.select("k", at("width"), at("frame_count"), at("has_audio"), at("chroma"), at("color_space"))


@query("stream_durations", f"WITH {CATALOGUE} SELECT k, video_s AS video, CASE WHEN channels IS NOT NULL THEN audio_s END AS audio FROM cat")
def stream_durations(spark, sf):
    return probe.stream_durations(probe_documents(spark, sf))


def inventory(spark, sf):
    return boxes.boxes_of_content(movie_files(spark, sf))


# Files cut short: with the movie first they keep it and lose the media box, else they have no movie box.
NO_MOVIE = "(k % 17 = 0 AND k % 2 = 1)"


@query("boxes", f"""WITH {CATALOGUE}, n AS (SELECT path, k, channels IS NOT NULL AS snd, channels IN (4, 9, 16) AS amb FROM cat),
t AS (SELECT path, k, unnest(CASE WHEN {NO_MOVIE} THEN ['ftyp', 'mdat', 'corrupt'] ELSE list_concat([CASE WHEN k % 17 = 0 THEN 'corrupt' ELSE 'mdat' END, 'ftyp', 'moov', 'mvhd', 'trak', 'mdia', 'hdlr', 'minf', 'stbl', 'stsd', 'avcC'],
  CASE WHEN k % 3 = 0 THEN ['uuid'] ELSE [] END, CASE WHEN k % 4 = 0 THEN ['st3d', 'sv3d', 'svhd', 'proj', 'prhd', 'equi'] ELSE [] END,
  CASE WHEN snd THEN ['trak', 'mdia', 'hdlr', 'minf', 'stbl', 'stsd'] ELSE [] END, CASE WHEN amb THEN ['SA3D'] ELSE [] END) END) AS type FROM n)
SELECT path, type, count(*) AS n FROM t GROUP BY path, type""")
def box_counts(spark, sf):
    return inventory(spark, sf).groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


@query("sphere_tags", f"""WITH {CATALOGUE} SELECT path, k % 3 = 0 AND NOT {NO_MOVIE} AS v1, k % 4 = 0 AND NOT {NO_MOVIE} AS v2, (k % 3 = 0 OR k % 4 = 0) AND NOT {NO_MOVIE} AS tagged,
  CASE WHEN k % 17 <> 0 THEN k % 2 = 0 END AS mdat_after_moov FROM cat""")
def sphere_tags(spark, sf):
    b = boxes.marks(inventory(spark, sf))
    return boxes.has_sphere_tags(b).join(boxes.media_after_movie(b), "path")


@query("untagged_files", f"WITH {CATALOGUE} SELECT path FROM cat WHERE {NO_MOVIE} OR NOT (k % 3 = 0 OR k % 4 = 0)")
def untagged_files(spark, sf):
    return boxes.untagged(catalogue(spark, sf).select("path"), inventory(spark, sf))


@query("ambisonic_tags", f"""WITH {CATALOGUE} SELECT path, 0 AS version, 0 AS ambisonic_type, {ORDER} AS "order", 0 AS channel_ordering, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS normalization,
  channels, k % 6 <> 0 AS usable FROM cat WHERE channels IN (4, 9, 16) AND NOT {NO_MOVIE}""")
def ambisonic_tags(spark, sf):
    a = boxes.ambisonic(inventory(spark, sf))
    return a.withColumn("usable", media.declares_ambix(F.struct(*a.columns)))


FOUND = f"""found AS (SELECT path, 'st3d' AS tag, k % 3 AS value FROM cat WHERE k % 4 = 0 AND NOT {NO_MOVIE}
  UNION ALL SELECT path, 'equi', CASE WHEN k % 8 = 0 THEN 1073741824 ELSE 0 END FROM cat WHERE k % 4 = 0 AND NOT {NO_MOVIE}
  UNION ALL SELECT path, 'uuid', 1 FROM cat WHERE k % 3 = 0 AND NOT {NO_MOVIE}
  UNION ALL SELECT path, 'SA3D', sqrt(channels)::INT - 1 FROM cat WHERE channels IN (4, 9, 16) AND NOT {NO_MOVIE})"""
WANTED = """wanted AS (SELECT path, 'st3d' AS tag, CASE WHEN mode = 'vr180' THEN 2 ELSE 1 END AS value FROM cat
  UNION ALL SELECT path, 'equi', CASE WHEN mode = 'vr180' THEN 1073741824 ELSE 0 END FROM cat
  UNION ALL SELECT path, 'uuid', 1 FROM cat WHERE mode = '360'
  UNION ALL SELECT path, 'SA3D', sqrt(channels)::INT - 1 FROM cat WHERE channels IN (4, 9, 16))"""


@query("tag_audit", f"""WITH {CATALOGUE}, {FOUND}, {WANTED}
SELECT *, 'missing' AS problem FROM (SELECT * FROM wanted EXCEPT ALL SELECT * FROM found) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM found EXCEPT ALL SELECT * FROM wanted)""")
def tag_audit(spark, sf):
    plan = catalogue(spark, sf).select(
        "path", F.when(C("mode") == "vr180", "left-right").otherwise("top-bottom").alias("stereo_mode"),
        F.when(C("mode") == "vr180", 180.0).otherwise(360.0).alias("fov"), C("channels").alias("audio_channels"))
    return boxes.tag_audit(plan, inventory(spark, sf))


@query("photo_sphere", f"""WITH {CATALOGUE} SELECT path, CASE WHEN k % 4 <> 0 THEN 'equirectangular' END AS projection, CASE WHEN k % 4 <> 0 THEN width END AS full_width FROM cat""")
def photo_sphere(spark, sf):
    a = photosphere.attributes(photo_files(spark, sf))
    return a.select("path", C("tags")["ProjectionType"].alias("projection"), C("tags")["FullPanoWidthPixels"].cast("int").alias("full_width"))
