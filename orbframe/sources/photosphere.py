"""Photo-sphere attributes of JPEG files."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The header that marks an XMP segment, and JPEG markers.
XMP_HEADER = b"http://ns.adobe.com/xap/1.0/\x00"
START, END, SCAN, APP1 = 0xD8, 0xD9, 0xDA, 0xE1


def _xmp(data: bytes) -> str | None:
    """Text of the XMP segment, found along the marker chain only."""
    if data[:2] != bytes([0xFF, START]):
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (START, END, SCAN):
        stop = at + 2 + int.from_bytes(data[at + 2:at + 4], "big")
        body = data[at + 4:stop]
        if data[at + 1] == APP1 and body.startswith(XMP_HEADER):
            return body[len(XMP_HEADER):].decode("utf-8", "replace")
        at = stop
    return None


def attributes(files: DataFrame) -> DataFrame:
    """``(path, tags map)`` for JPEG rows ``(path, content)``; NULL without XMP."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "xmp": [_xmp(c) for c in pdf["content"]]})

    pattern = r'GPano:(\w+)="([^"]*)"'
    text = files.select("path", "content").mapInPandas(run, "path string, xmp string")
    names = F.regexp_extract_all("xmp", F.lit(pattern), 1)
    values = F.regexp_extract_all("xmp", F.lit(pattern), 2)
    # A repeated attribute keeps its last value.
    pairs = F.aggregate(
        F.arrays_zip(names.alias("n"), values.alias("v")), F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["n"]), F.create_map(p["n"], p["v"])),
    )
    return text.select("path", F.when(F.col("xmp").isNotNull(), pairs).alias("tags"))
