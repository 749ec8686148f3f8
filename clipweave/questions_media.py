"""Registered queries of pictures, media places and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import identity, imaging, vision
from .queries import query
from .questions import graph
from .sources import paths
from .sources.tables import table
from .twins import with_graph


@query(
    "picture_brightness",
    """with x as (select vec_id, label, list_sum(list_transform(embedding, lambda x: cast(cast(floor(abs(x) * 400) as int) % 256 as double))) / len(embedding) as luma from embeddings)
    select vec_id, round(luma, 6) as luma, luma < 78 as night, count(*) filter (luma < 78) over w >= greatest(1, count(*) over w // 2) as night_clip from x window w as (partition by label)""",
)
def picture_brightness(spark: SparkSession, folder: str) -> DataFrame:
    pixels = F.transform("embedding", lambda x: F.floor(F.abs(x) * 400).cast("int") % 256)
    p = table(spark, folder, "embeddings").select("vec_id", "label", imaging.luma_mean(pixels).alias("luma"))
    clips = p.groupBy("label").agg(F.collect_list(imaging.is_night(F.col("luma"))).alias("nights")).select("label", imaging.night_clip(F.col("nights")).alias("night_clip"))
    return p.join(clips, "label").select("vec_id", F.round("luma", 6).alias("luma"), imaging.is_night(F.col("luma")).alias("night"), "night_clip")


_BOX = "[cast(floor(embedding[1] * 1000) as int), cast(floor(embedding[2] * 1000) as int), cast(floor(embedding[1] * 1000) as int) + cast(floor(abs(embedding[3]) * 900) as int), cast(floor(embedding[2] * 1000) as int) + cast(floor(abs(embedding[4]) * 900) as int)]"


@query(
    "picture_crops",
    f"""with b as (select vec_id, {_BOX} as b from embeddings), c as (select vec_id, greatest(0, b[1]) as x1, greatest(0, b[2]) as y1, least(640, b[3]) as x2, least(360, b[4]) as y2 from b),
    d as (select *, cast(floor((x2 - x1) * 0.08::double) as int) as pad, y1 + cast(floor((y2 - y1) * 0.55::double) as int) as top from c)
    select vec_id, case when x2 - x1 >= 20 and y2 - y1 >= 20 then concat_ws(',', x1, y1, x2, y2) end as person,
      case when x2 - x1 >= 24 and y2 - y1 >= 24 and x2 - x1 - 2 * pad >= 24 and y2 - top >= 12 then concat_ws(',', x1 + pad, top, x2 - pad, y2) end as plate from d""",
)
def picture_crops(spark: SparkSession, folder: str) -> DataFrame:
    at = lambda i, k=1000: F.floor(F.element_at("embedding", i) * k).cast("int")
    side = lambda i: F.floor(F.abs(F.element_at("embedding", i)) * 900).cast("int")
    box = F.array(at(1), at(2), at(1) + side(3), at(2) + side(4))
    text = lambda crop: F.when(crop.isNotNull(), F.array_join(F.transform(crop, lambda x: x.cast("string")), ","))
    w, h = F.lit(640), F.lit(360)
    return table(spark, folder, "embeddings").select("vec_id", text(imaging.person_crop(box, w, h)).alias("person"), text(imaging.plate_crop(box, w, h)).alias("plate"))


@query(
    "picture_fits",
    """with v as (select distinct video_id, width, height from videos where height > 0 and width > 0), s as (select *, least(640.0::double / width, 640.0::double / height) as scale, least(320.0::double / width, 180.0::double / height) as small from v),
    n as (select *, cast(round_even(width * scale, 0) as int) as w, cast(round_even(height * scale, 0) as int) as h, greatest(1, cast(floor(width * small) as int)) as cw, greatest(1, cast(floor(height * small) as int)) as ch from s)
    select video_id, round(scale, 9) as scale, w, h, (640 - w) / 2.0::double as pad_x, (640 - h) / 2.0::double as pad_y, cw, ch, (320 - cw) // 2 as cell_left, (180 - ch) // 2 as cell_top from n""",
)
def picture_fits(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "videos").where("height > 0 and width > 0").select("video_id", "width", "height").distinct()
    rows = v.select("video_id", imaging.letterbox(F.col("width"), F.col("height")).alias("b"), imaging.fit_cell(F.col("width"), F.col("height"), 320, 180).alias("c"))
    return rows.select(
        "video_id", F.round("b.scale", 9).alias("scale"), F.col("b.width").alias("w"), F.col("b.height").alias("h"), "b.pad_x", "b.pad_y", F.col("c.width").alias("cw"), F.col("c.height").alias("ch"),
        F.col("c.left").alias("cell_left"), F.col("c.top").alias("cell_top"),
    )


@query(
    "images_for_a_model",
    with_graph(
        """, x as (select id, idx % 2 = 0 as key_clip, case when idx % 5 <> 0 then id || '/splice.jpg' end as splice, list_transform(range(0, idx % 4), lambda i: id || '/cell_' || i) as frames,
          [case when idx % 3 = 0 then id || '/p' end, id || '/q', id || '/splice.jpg', id || '/r'] as crops from clip)
        select id, array_to_string(list_slice(list_filter([splice, case when key_clip then frames[len(frames) // 2 + 1] end, case when key_clip then c[1] end,
          case when key_clip and c[2] is distinct from splice then c[2] end], lambda z: z is not null), 1, case when key_clip then 4 else 1 end), ',') as images
        from (select *, list_filter(crops, lambda z: z is not null)[1:2] as c from x)"""
    ),
)
def images_for_a_model(spark: SparkSession, folder: str) -> DataFrame:
    c = graph(spark, folder).node("clip", "id", "index")
    path = lambda name: F.concat("id", F.lit(f"/{name}"))
    n, i = (F.col("index") % 4).cast("int"), F.col("index")
    frames = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat("id", F.lit("/cell_"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    crops = F.array(F.when(i % 3 == 0, path("p")), path("q"), path("splice.jpg"), path("r"))
    return c.select("id", F.array_join(imaging.shown_images(i % 2 == 0, F.when(i % 5 != 0, path("splice.jpg")), frames, crops), ",").alias("images"))


@query(
    "media_places",
    """with u as (select distinct video_id, source_name, 'file:///store/data/videos/' || video_id || case when duration_s > 2000 then '_00ab12cd' else '' end || '/clip.mp4' as uri from videos)
    select video_id, '/mnt/videos/' || video_id || '/clip.mp4' as here, starts_with(video_id, 'v_g') as allowed,
      array_to_string(list_sort(list_distinct([video_id, regexp_replace(source_name, '\\.[^.]*$', '')])), ',') as ids from u""",
)
def media_places(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "videos").select("video_id", "source_name", "duration_s").distinct()
    uri = F.concat(F.lit("file:///store/data/videos/"), "video_id", F.when(F.col("duration_s") > 2000, "_00ab12cd").otherwise(""), F.lit("/clip.mp4"))
    here = paths.local_uri(uri, {"/store/data": "/mnt", "/store": "/elsewhere"})
    may = paths.allowed(F.concat(F.lit("/mnt/"), F.substring("video_id", 1, 3), F.lit("/x")), ["/mnt/v_g", "/other"])
    ids = paths.previous_ids(F.col("video_id"), F.lit(None).cast("string"), F.col("source_name"))
    return v.select("video_id", here.alias("here"), may.alias("allowed"), F.array_join(F.array_sort(ids), ",").alias("ids"))


@query(
    "committed_identities",
    with_graph(
        """select video_id, 'person_' || row_number() over (partition by video_id order by idx nulls first, id) as local_id, 'coat ' || idx as clothes, idx as first_clip from clip where idx % 2 = 0"""
    ),
)
def committed_identities(spark: SparkSession, folder: str) -> DataFrame:
    """A model's answer for each clip: on even ones a new person in a coat, on odd ones the first person again."""
    c = graph(spark, folder).node("clip", "id", "video_id", "index")
    new = F.concat(F.lit('so: {"people": [{"id": "", "local_id": "p", "match": "new", "clothes": "coat '), F.col("index").cast("string"), F.lit('"}], "vehicles": []}'))
    told = F.when(F.col("index") % 2 == 0, new).otherwise('{"people": [{"id": "person_1", "match": "existing"}]}')
    people, _ = vision.committed(c.select("video_id", F.col("index").alias("clip_index"), told.alias("answer")))
    return identity.cards_of(identity.fold_people(people)).where("clothes <> ''").select("video_id", "local_id", "clothes", "first_clip")
