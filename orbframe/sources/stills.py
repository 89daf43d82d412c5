"""Still images: listing, classification and decoding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbframe.functions import media


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder with their kind; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return classify(files.select("path", "length", "modificationTime"))


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``ext, still, jpeg, writable`` from the extension, in any case."""
    p = F.col(path)
    return files.withColumns({
        "ext": media.extension(p), "still": media.is_still(p), "jpeg": media.is_jpeg(p), "writable": media.is_writable_still(p),
    })


def read_stills(spark: SparkSession, path: str) -> DataFrame:
    """Still images to pixels ``(clip, f = 0, y, x, r, g, b)``.

    Decodes the formats the JVM can read; stored rows are blue, green, red
    (and alpha), or a single grey channel.
    """
    img = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    n, w = F.col("nChannels"), F.col("width")
    level = lambda i, c: F.conv(F.hex(F.substring("data", i * n + F.least(F.lit(c), n - 1) + 1, F.lit(1))), 16, 10).cast("int")
    px = lambda i: F.struct(
        (i / w).cast("int").alias("y"), (i % w).cast("int").alias("x"),
        level(i, 2).alias("r"), level(i, 1).alias("g"), level(i, 0).alias("b"),
    )
    cells = F.transform(F.sequence(F.lit(0), F.col("height") * w - 1), px)
    return img.select(F.col("origin").alias("clip"), F.lit(0).alias("f"), F.inline(cells))
