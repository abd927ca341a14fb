from edges import CLASHES, documents, none
from pyspark.sql import functions as F

from quadspark.llm import langid as lg


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    dicts = lg.dictionaries(lg.training_rows(docs, where=third != 1))
    held = lg.identify(docs.where(third == 1), dicts)
    rows = held.collect()
    assert set(dicts) == {"de", "en", "es", "fr"}
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    clear = [r for r in rows if not r.rejected]
    assert len(clear) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_sample_is_bounded(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"), F.when(F.col("id") < 1990, "a").otherwise("b").alias("lang"))
    docs = docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    rows = lg.training_rows(docs, sample_docs=50)
    assert 0 < sum(x == "a" for x, _ in rows) <= 50 and sum(x == "b" for x, _ in rows) == 10


def test_a_rare_language_takes_nothing_from_the_others():
    rows = [(lang, f"{lang} " + "word " * 70 + str(i)) for lang in ("a", "b") for i in range(200)]
    alone = lg.dictionaries(rows)
    assert min(map(len, alone.values())) > 60_000
    assert lg.dictionaries([*rows, ("rare", "one short row"), ("none", "123 ")]) == {**alone, "rare": b"one short row"}


def test_pieces_come_from_all_over_the_texts_in_hash_order(spark):
    rows = [(i, f"start{i} " + "x" * 3000 + " middle " + "y" * 3000 + f" end{i}", "a") for i in range(40)] + [(100, "short", "a"), (101, "short", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [part for _, part in lg.training_rows(docs)]
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id")).collect() if r.doc_id < 100]
    long = [part for part in got if part != "short"]
    assert [part.split()[0] for part in long] == [f"start{i}" for i in order] and got.count("short") == 1
    assert all("y" in part and part.split()[-1] == f"end{i}" and len(part) <= 403 for part, i in zip(long, order))


def brute(text, dicts):
    """The language of the smallest sum of compressed pieces, by compressors made for each piece."""
    import zstandard as z

    letters = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    own = " ".join(letters.split(" ")).encode()
    own = b" ".join(own.split())
    sums = {}
    for lang, data in dicts.items():
        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        sums[lang] = sum(len(z.ZstdCompressor(level=lg.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(own[i : i + lg.PIECE])) for i in range(0, len(own), lg.PIECE))
    order = sorted(sums, key=lambda x: (sums[x], x))
    return order[0], 1 - sums[order[0]] / sums[order[1]]


def test_predictions_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    docs = docs.unionByName(docs.where("doc_id < 3"))  # repeated rows are sampled once
    rows = lg.training_rows(docs)
    assert rows == lg.training_rows(docs.distinct()) and len(rows) == len(set(rows))
    dicts = lg.dictionaries(rows)
    for r in lg.identify(docs, dicts).collect():
        if any(map(str.isalpha, r.text)):
            lang, score = brute(r.text, dicts)
            assert r.lang_pred == lang and abs(r.score - score) < 0.01


def test_edges(spark):
    docs = documents(spark)
    dicts = {"en": b"alpha beta gamma delta words one " * 40, "xx": b"qqq zzz vvv jjj kkk www " * 40}
    got = lg.identify(docs, dicts)
    rows = got.collect()
    assert len(rows) == docs.count() and set(CLASHES) <= set(got.columns)
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in dicts
    assert lg.identify(none(docs), dicts).count() == 0
    assert {r.lang_pred for r in lg.identify(docs, {}).collect()} == {"und"}
    assert lg.training_rows(none(docs)) == [] and lg.dictionaries([]) == {}
