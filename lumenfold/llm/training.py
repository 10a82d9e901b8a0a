"""Bounded, deterministic samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textbuf import held_out


#: Labels learned at most, the most frequent ones, and bytes of text that reach the driver.
CLASSES, BYTES = 256, 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, values: list | None = None, classes: int = CLASSES, most_bytes: int = BYTES) -> tuple[list[bytes], list, dict]:
    """Texts, labels and the number of labelled rows by label, of rows that aren't held out.

    About per_class rows of each label are taken, those whose hashed doc_id comes first, and never more, in that order and as whole texts for as long as they have at most `most_bytes` together; only they reach the
    driver. Rows without text, label or doc_id are not taken, nor, where `values` is given, rows with other labels; of more than `classes` labels the most frequent are learned, of equally frequent ones the lesser.
    A doc_id with several labels counts with its largest, one with several texts with the least.
    """
    known = F.col(label).isNotNull() if values is None else F.col(label).isin(values)
    rows = labels.filter(known & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(classes).collect()}
    if not sizes:
        return [], [], {}
    rank = (F.xxhash64("doc_id") - F.lit(-(2**63)).cast("decimal(20,0)")) / F.lit(2.0**64)
    share = F.try_element_at(F.create_map(*(F.lit(x) for value, n in sizes.items() for x in (value, per_class / n))), F.col("label"))
    picked = rows.withColumn("rank", rank).filter(F.col("rank") < share)  # about per_class rows a label, so bounded
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("words")).filter(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(picked), F.col("id") == F.col("doc_id")).groupBy("doc_id", "label", "rank").agg(F.min("words").alias("words"))
    total = F.sum(F.octet_length("words")).over(W.orderBy("rank", "doc_id"))  # of the bounded sample
    got = joined.withColumn("total", total).filter(F.col("total") <= most_bytes).orderBy("rank", "doc_id").select("label", "words").toArrow()
    out_texts, out, taken = [], [], dict.fromkeys(sizes, 0)
    for value, string in zip(got["label"].to_pylist(), got["words"].to_pylist()):
        taken[value] += 1
        if taken[value] <= per_class:
            out_texts.append(string.encode("utf-8", "replace"))
            out.append(value)
    return out_texts, out, sizes
