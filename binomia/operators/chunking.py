"""Texts cut into chunks of words for a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_space, words
from .segment import sentences

OVERLAP = 50


def word_windows(ws: Column, size: int, step: int | None = None) -> Column:
    """Windows of `size` words, joined by spaces: side by side, or `step` apart until one reaches the end."""
    n = F.size(ws)
    if step is None:
        last = F.floor((n - 1) / size)
        step = size
    else:
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.array_join(F.slice(ws, i * step + 1, F.lit(size)), " ")))


def tumbling(text: Column, size: int) -> Column:
    return F.transform(F.array(words(text)), lambda w: word_windows(w, size))[0]


def sliding(text: Column, size: int, overlap: int = OVERLAP) -> Column:
    return F.transform(F.array(words(text)), lambda w: word_windows(w, size, max(size - overlap, 1)))[0]


def _pack(items: Column, least: int | None, most: int) -> Column:
    """Chunks of items (text, n words, parts): an item over `most` flushes and brings its parts; others are joined by
    spaces; a paragraph chunk (least given) is flushed from `least` words on, a sentence chunk before it would pass `most`."""
    none = F.array().cast("array<string>")
    flushed = lambda a: F.when(F.size(a["buf"]) > 0, F.concat(a["out"], F.array(F.array_join(a["buf"], " ")))).otherwise(a["out"])
    state = lambda out, buf, n: F.struct(out.alias("out"), buf.alias("buf"), n.cast("int").alias("n"))

    def step(a: Column, x: Column) -> Column:
        big = state(F.concat(flushed(a), x["parts"]), none, F.lit(0))
        if least is not None:
            grown, n = F.concat(a["buf"], F.array(x["text"])), a["n"] + x["n"]
            small = F.when(n >= least, state(F.concat(a["out"], F.array(F.array_join(grown, " "))), none, F.lit(0))).otherwise(state(a["out"], grown, n))
        else:
            fits = a["n"] + x["n"] <= most
            small = F.when(fits, state(a["out"], F.concat(a["buf"], F.array(x["text"])), a["n"] + x["n"])).otherwise(state(flushed(a), F.array(x["text"]), x["n"]))
        return F.when(x["n"] > most, big).otherwise(small)

    return F.aggregate(items, state(none, none, F.lit(0)), step, flushed)


def _sentence_chunks(docs: DataFrame, most: int, text_col: str, key: list[str]) -> DataFrame:
    """key, chunks: sentences packed in order up to `most` words; longer ones slide."""
    own = docs.select(*key, F.col(text_col).alias("_t")).withColumn("_k", F.struct(*key))
    spans = sentences(own, "_t", "_k").withColumn("n", F.size(words(F.col("text")))).withColumn("parts", sliding(F.col("text"), most))
    packed = spans.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "text", "n", "parts"))).alias("s"))
    return packed.select(*[F.col(f"_k.{k}").alias(k) for k in key], _pack(F.col("s"), None, most).alias("chunks"))


def chunks(docs: DataFrame, strategy: str = "paragraph", least: int = 50, most: int = 500, text_col: str = "text", id_col: str = "doc_id", by_sentences: bool = True) -> DataFrame:
    """(doc_id, idx, chunk).

    paragraph: blocks between blank lines, gathered up to `least` words; one over `most` is split by its own sentences (or by
    words). page: the text's sentences packed up to `most` words (or words alone).
    """
    if strategy not in ("paragraph", "page"):
        raise ValueError(f"Unknown chunk strategy: {strategy}")
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("_text"))
    if strategy == "page":
        cut = _sentence_chunks(own, most, "_text", [id_col]) if by_sentences else own.select(id_col, tumbling(F.col("_text"), most).alias("chunks"))
        return cut.select(id_col, F.posexplode("chunks").alias("idx", "chunk"))
    paragraphs = F.filter(F.transform(F.split("_text", "\n\n"), strip_space), lambda x: x != "")
    each = own.select(id_col, F.posexplode(paragraphs).alias("p", "para")).withColumn("n", F.size(words(F.col("para"))))
    if by_sentences:
        long = _sentence_chunks(each.where(F.col("n") > most), most, "para", [id_col, "p"]).withColumnRenamed("chunks", "parts")
        each = each.join(long, [id_col, "p"], "left")
    else:
        each = each.withColumn("parts", F.when(F.col("n") > most, tumbling(F.col("para"), most)))
    each = each.withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    packed = each.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("p", F.col("para").alias("text"), "n", "parts"))).alias("s"))
    return packed.select(id_col, F.posexplode(_pack(F.col("s"), least, most)).alias("idx", "chunk"))
