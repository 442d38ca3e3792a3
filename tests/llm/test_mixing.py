import re

from pyspark.sql import functions as F

from tallyweave.llm import mixing


def report(docs, **options):
    return mixing.mix_report(docs, **options).collect()


def targets(sizes, weights=(5, 2, 1)):
    """Water-filling, step by step: the share of sources over their cap goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def corpus(spark, rows=600):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.col("id") % 97 + 1), lambda i: F.concat(F.lit("w"), i)), " ")
    source = F.element_at(F.array(*map(F.lit, ["big", "mid", "small", "tiny"])), (F.when(F.col("id") % 10 < 6, 1).when(F.col("id") % 10 < 8, 2).when(F.col("id") % 10 < 9, 3).otherwise(4)).cast("int"))
    return spark.range(rows).select(F.col("id").alias("doc_id"), words.alias("text"), source.alias("source"))


def test_taken_words_meet_the_targets(spark):
    docs = corpus(spark)
    rows = report(docs, block_words=16)
    sizes, taken = {}, {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16 + 0.01 * want[s]
    assert all(abs(r.target - want[source[r.doc_id]]) < 1e-6 for r in rows)


def test_reruns_and_partitions_agree(spark):
    docs = corpus(spark, 200)
    assert sorted(report(docs)) == sorted(report(docs.repartition(7)))


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        side = int(n**0.5)
        place = mixing.permuted(F.col("id"), F.lit(n), F.lit(123456789), F.lit(side), F.lit(n // side))
        assert sorted(r[0] for r in spark.range(n).select(place).collect()) == list(range(n))


def test_every_block_is_taken_before_any_twice(spark):
    slots = mixing.dealt_slots(spark.createDataFrame([(0, 10, 15, 0, 15, 15), (1, 4, 3, 15, 18, 18)], "sid long, blocks long, quota long, low long, high long, slots long"), "s", 4)
    times = {(r.sid, r.block): r["count"] for r in slots.groupBy("sid", "block").count().collect()}
    assert sum(v for (s, _), v in times.items() if s == 0) == 15 and {v for (s, _), v in times.items() if s == 0} == {1, 2}
    assert len([1 for s, _ in times if s == 0]) == 10 and sorted(v for (s, _), v in times.items() if s == 1) == [1, 1, 1]
    assert slots.select("slot").distinct().count() == 18


def test_mixed_texts_hold_the_words_taken(spark):
    docs = corpus(spark, 150)
    mixed = mixing.mix_documents(docs, block_words=16).collect()
    taken = {r.doc_id: r.taken for r in report(docs, block_words=16)}
    found, texts = {}, {r.doc_id: r.text for r in docs.collect()}
    for r in mixed:
        found[r.doc_id] = found.get(r.doc_id, 0) + len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split())
    assert found == {i: n for i, n in taken.items() if n}


def test_odd_rows(odd_docs):
    words = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd_docs.collect())
    rows = report(odd_docs, block_words=8)
    assert sorted(r.size for r in rows) == words
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    mixed = mixing.mix_documents(odd_docs, block_words=8)
    assert mixed.columns == odd_docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_empty_table(no_docs):
    assert report(no_docs) == [] and mixing.mix_documents(no_docs).collect() == []


def test_tables_without_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.taken) for r in report(docs)) == [(1, 0, 0), (2, 0, 0)]
    assert mixing.mix_documents(docs).collect() == []
