"""Asset, frame and candidate tables made from the test tables, for queries and their SQL.

Each is given twice: for Spark, and as DuckDB SQL over the views of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ASSETS = """
SELECT doc_id, w, h,
  concat('/assets/', cast(doc_id % 13 AS {string}), '/', cast(doc_id AS {string}),
    CASE doc_id % 7 WHEN 0 THEN '.gif' WHEN 1 THEN '.GIF' WHEN 2 THEN '.png' WHEN 3 THEN '.jpg'
                    WHEN 4 THEN '.jpeg' WHEN 5 THEN '.png' ELSE '.jpg' END) AS path,
  CASE
    WHEN doc_id % 29 = 0 THEN ''
    WHEN doc_id % 7 IN (0, 4) THEN concat('474946383961', substr({w4},3,2), substr({w4},1,2), substr({h4},3,2), substr({h4},1,2), '800000', body)
    WHEN doc_id % 7 = 1 THEN concat('474946383761', substr({w4},3,2), substr({w4},1,2), substr({h4},3,2), substr({h4},1,2), '000000', body)
    WHEN doc_id % 7 = 2 THEN concat('89504E470D0A1A0A0000000D49484452', {w8}, {h8}, '0802', body)
    WHEN doc_id % 7 = 3 THEN concat('FFD8FFE000104A46494600010100000100010000',
      CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'FFC40004AABB' WHEN 2 THEN 'FFFE0002' ELSE 'FFD80002FFC00008110001000101FFD90002' END,
      CASE WHEN doc_id % 2 = 0 THEN 'FFC0' ELSE 'FFC2' END, '001108', {h4}, {w4}, '03', body)
    ELSE body
  END AS chex
FROM (SELECT doc_id, {body} AS body,
        CASE WHEN doc_id % 50 = 0 THEN cast(0 AS bigint) ELSE 1 + (doc_id * 37) % 3000 END AS w,
        1 + (doc_id * 91) % 2000 AS h
      FROM documents)
"""
_SPARK = {"string": "string", "w4": "lpad(hex(w),4,'0')", "h4": "lpad(hex(h),4,'0')", "w8": "lpad(hex(w),8,'0')", "h8": "lpad(hex(h),8,'0')", "body": "hex(cast(text AS binary))"}
_DUCK = {"string": "varchar", "w4": "printf('%04X', w)", "h4": "printf('%04X', h)", "w8": "printf('%08X', w)", "h8": "printf('%08X', h)", "body": "hex(encode(text))"}

ASSETS_SQL = _ASSETS.format(**_DUCK)

PIXELS_SQL = """
SELECT label AS asset_id, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, pos,
  CASE WHEN c = 13 THEN NULL ELSE c END AS color
FROM (SELECT label, vec_id, unnest(range(0, 64)) AS pos, cast(floor(cast(unnest(embedding) AS double) * 8) AS int) + 16 AS c FROM embeddings)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, w, h, path, content, length)."""
    made = spark.sql(_ASSETS.format(**_SPARK).replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    # A generator's column is made once, however often it is used later.
    return made.select("*", F.explode(F.array(F.unhex("chex"))).alias("content")).withColumn("length", F.length("content").cast("long")).drop("chex")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, frame_no, pos, color): each vector a frame of 8 x 8, each label an animation.

    Frames are numbered on (label, vec_id), before vectors are exploded into pixels.
    """
    from pyspark.sql import Window

    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    numbered = vectors.withColumn("frame_no", F.dense_rank().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    rows = numbered.select(F.col("label").alias("asset_id"), "frame_no", F.posexplode("embedding").alias("pos", "v"))
    c = F.floor(F.col("v").cast("double") * 8).cast("int") + 16
    return rows.select("asset_id", "frame_no", "pos", F.when(c != 13, c).alias("color"))


def containers(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(path, content): pages as comments in small images, in as many segments as they need."""
    body = F.hex(F.col("html").cast("binary"))
    pages = table(spark, sf_dir, "pages").filter("html IS NOT NULL AND html != ''").select("page_id", body.alias("body"))
    if kind == "jpeg":
        size, head, tail = 60_000, "FFD8FFE000104A46494600010100000100010000", "FFC00011080020001003011100021101031101FFDA0008010100003F00D2CF20FFD9"
        segments = F.expr(f"transform(sequence(0, (length(body) div 2 - 1) div {size}), i -> concat('FFFE', lpad(hex(length(substr(body, i * {2 * size} + 1, {2 * size})) div 2 + 2), 4, '0'), substr(body, i * {2 * size} + 1, {2 * size})))")
        comments = F.array_join(segments, "")
    else:
        size, head, tail = 255, "47494638396110002000000000", "2C00000000100020000002024C01003B"
        segments = F.expr("transform(sequence(0, (length(body) div 2 - 1) div 255), i -> concat(lpad(hex(length(substr(body, i * 510 + 1, 510)) div 2), 2, '0'), substr(body, i * 510 + 1, 510)))")
        comments = F.concat(F.lit("21FE"), F.array_join(segments, ""), F.lit("00"))
    path = F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".jpg" if kind == "jpeg" else ".gif"))
    return pages.select(path.alias("path"), F.unhex(F.concat(F.lit(head), comments, F.lit(tail))).alias("content"))


#: An image of 32 x 32 grey pixels, all 0, as it is filtered, and stored without compression.
GREY = bytes(32 * 33)
_STORED = "7801" + "01" + len(GREY).to_bytes(2, "little").hex() + (0xFFFF - len(GREY)).to_bytes(2, "little").hex() + GREY.hex() + "04200001"


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each page as a comment in a whole JPEG, GIF and PNG, each with something of its own to keep; every tenth page's files twice.

    Kept are the URL in an application segment of the JPEG and in a private chunk of the PNG, and a colour table of the GIF.
    """
    pages = table(spark, sf_dir, "pages").filter("html IS NOT NULL AND html != ''")
    # Encoding costs far more than its input's size tells, so a small table is dealt over all cores.
    pages = pages.select("page_id", "url", "html").repartition(spark.sparkContext.defaultParallelism, "page_id")
    rows = pages.select("page_id", F.hex(F.col("html").cast("binary")).alias("body"), F.hex(F.coalesce("url", F.lit("")).cast("binary")).alias("url"))

    def sized(hex_text, digits: int, more: int = 0):
        return F.lpad(F.hex((F.length(hex_text) / 2 + more).cast("long")), digits, "0")

    def pieces(size: int, digits: int, head: str, more: int):
        at = F.sequence(F.lit(0).cast("long"), F.floor((F.length("body") - 1) / (2 * size)))
        return F.array_join(F.transform(at, lambda i: F.concat(F.lit(head), sized(F.substring("body", (i * 2 * size + 1).cast("int"), F.lit(2 * size)), digits, more), F.substring("body", (i * 2 * size + 1).cast("int"), F.lit(2 * size)))), "")

    def chunk(name: str, data):
        named = F.concat(F.lit(name.encode().hex()), data)
        return F.concat(sized(data, 8), named, F.lpad(F.hex(F.crc32(F.unhex(named))), 8, "0"))

    url, body = F.col("url"), F.col("body")
    flags = F.col("page_id") % 8
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFEE"), sized(url, 4, 2), url, pieces(60_000, 4, "FFFE", 2), F.lit("FFC00011080020001003011100021101031101FFDA0008010100003F00D2CF20FFD9"))
    gif = F.concat(
        F.lit("47494638396110002000"), F.lpad(F.hex(flags + 0x80), 2, "0"), F.lit("0000"), F.repeat(F.lit("00"), (3 * F.pow(F.lit(2), flags + 1)).cast("int")),
        F.lit("21F904000000000021FE"), pieces(255, 2, "", 0), F.lit("002C00000000100020000002024C01003B"),
    )
    png = F.concat(
        F.lit("89504E470D0A1A0A"), chunk("IHDR", F.lit("0000002000000020" + "0800000000")), chunk("prVt", url), chunk("tEXt", body), chunk("IDAT", F.lit(_STORED)), chunk("IEND", F.lit("")),
    )
    every = rows.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.unhex(c).alias("content")) for k, c in (("jpg", jpeg), ("gif", gif), ("PNG", png))))).alias("file"))
    folders = F.when(F.col("page_id") % 10 == 0, F.array(F.lit("pages"), F.lit("copies/of/pages"))).otherwise(F.array(F.lit("pages")))
    each = every.select("page_id", "file.*", F.explode(folders).alias("folder"))
    path = F.concat(F.col("folder"), F.lit("/"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit("."), F.col("kind"))
    return each.select(path.alias("path"), "content")
