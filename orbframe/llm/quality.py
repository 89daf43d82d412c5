"""Line-first quality rules, in DataFrame functions alone.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines
go, and a document that loses too much of its text goes with them. What is counted
on the whole text decides as well (``base_failed``).

A null text has no words and fails. An empty table gives no rows. Repeated rows are
judged one by one. Other columns pass through ``cleaned``, whatever their names.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: white space between words, symbols, windows and limits.
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Phrases that pages show around their texts.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot your password", "log in", "lorem ipsum",
    "privacy policy", "read more", "sign up", "skip to content", "subscribe to our newsletter", "terms of service", "terms of use", "use of cookies",
)
#: Shares (in hundredths): of marks among a line's characters, of words that end in such
#: marks, and of a document's characters that may go with failing lines.
MOST_MARKS, MOST_MARKED, MOST_LOST = 12, 30, 40
MARK = r"[#*$%&|<>{}\\^~_=!»•·]"
#: A boilerplate phrase counts against a line of so many words at most.
PHRASE_WORDS = 12


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns worked out once: a one-row generator keeps them from being inlined again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(c, WORD_GAP), "")


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, WORD_GAP, " "))


def says(low: Column) -> Column:
    """Whether a boilerplate phrase occurs in a text in lower case."""
    return reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE])


def fails(text: Column, low: Column) -> Column:
    """Whether a line, made normal, breaks the punctuation, navigation or boilerplate rule."""
    n = F.length(text)
    words = n - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    bars = F.regexp_count(text, F.lit(r" [|>»•·](?= |$)"))
    marks = F.regexp_count(text, F.lit(MARK))
    marked = F.regexp_count(text, F.lit(MARK + r"(?= |$)"))
    navigation = (bars >= 3) & (bars * 4 >= words)
    punctuation = (marks * 100 > n * MOST_MARKS) | ((marked * 100 > words * MOST_MARKED) & (words >= 3))
    return (n > 0) & (navigation | punctuation | ((words <= PHRASE_WORDS) & says(low)))


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the figures, ``base_failed``, ``kept`` and the ``cleaned`` text.

    New columns start with ``q_`` here (names that ``docs`` shouldn't use), so that columns of ``docs`` keep theirs.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = pinned(docs, q_text=text, q_low=normal(F.lower(text)), q_words=words_of(text), q_lines=F.split(text, "\n"))
    n = F.size("q_words")
    # hashes of 1, 2, 4 and 8 words from each word on; the last seven windows are cut short and go
    df = pinned(df, q_h=F.transform("q_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        df = pinned(df.withColumnRenamed("q_h", "q_g"), q_h=F.zip_with("q_g", F.slice("q_g", step + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))).drop("q_g")
    windows = F.slice("q_h", 1, F.greatest(n - (WINDOW - 1), F.lit(0)))
    # a line that fails has a mark or a phrase, and so has its text, with gaps made normal
    normals = F.when(F.rlike("q_text", F.lit(MARK)) | says(F.col("q_low")), F.transform("q_lines", normal))
    df = pinned(df, q_windows=windows, q_said=F.filter("q_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), q_normals=normals).drop("q_low")
    df = pinned(df, q_lows=F.transform("q_normals", F.lower))
    good = F.when(F.isnotnull("q_normals"), F.filter("q_lines", lambda x, i: ~fails(F.get("q_normals", i), F.get("q_lows", i)))).otherwise(F.col("q_lines"))
    # only texts with a window twice sort theirs, with positions
    twice = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    at = F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = pinned(df, q_sorted=F.when(twice, at), q_good=good)
    last = F.size("q_sorted") - 1
    same = lambda i, j: F.get("q_sorted", i)["h"] == F.get("q_sorted", j)["h"]
    hit = F.filter("q_sorted", lambda x, i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))) | ((i < last) & F.coalesce(same(i, i + 1), F.lit(False))))
    df = pinned(df, q_hits=F.sort_array(F.transform(hit, lambda x: x["i"])))
    covered = F.aggregate(F.transform("q_hits", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("q_hits", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = pinned(
        df,
        q_n_words=n.cast("long"),
        q_word_chars=F.length(F.array_join("q_words", "")).cast("long"),
        q_n_symbols=F.regexp_count("q_text", F.lit(SYMBOLS)).cast("long"),
        q_n_dup_lines=(F.size("q_said") - F.size(F.array_distinct("q_said"))).cast("long"),
        q_n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"),
        q_cleaned=F.array_join("q_good", "\n"),
    )
    failed = (F.col("q_n_words") < LEAST_WORDS) | (100 * F.col("q_n_repeat_words") > MOST_REPEATED * F.col("q_n_words"))
    lost = F.length("q_text") - F.length("q_cleaned")
    df = df.withColumn("q_base_failed", failed).withColumn("q_kept", ~failed & (lost * 100 <= F.length("q_text") * MOST_LOST))
    return df.drop("q_text", "q_words", "q_lines", "q_windows", "q_h", "q_said", "q_normals", "q_lows", "q_good", "q_sorted", "q_hits")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: the figures and the verdict."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"q_{n}").alias(n) for n in names])


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents kept, without their failing lines; ``n_chars`` follows where it is there."""
    df = judged(docs).where("q_kept")
    changes = {"text": F.col("q_cleaned")} | ({"n_chars": F.length("q_cleaned").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return df.withColumns(changes).select(*docs.columns)
