"""One thin query per operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, exact_dedup, mixing, near_dedup, neighbours, quality, repeats, secrets, spelling, substrings, toxicity, trie, url_filter
from tallyweave.llm.labels import remainder
from tallyweave.llm.mixing_sql import mix_sql
from tallyweave.llm.registry import query, table
from tallyweave.session import settle


@query(
    "op6_exact_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    )
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_mix_sources", mix_sql())
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


_LETTERS = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
_WORDS = "|".join("".join(_LETTERS.get(c, c) for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


@query(
    "op5_secret_scan",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    rules(kind, place, pattern, grp, least) AS (
      VALUES ('assign', 0, '{_ASSIGN}', 2, 12), ('access', 1, 'AKIA[A-Z0-9]+', 0, 18), ('hex', 2, '[0-9a-f]+', 0, 16)
    ),
    cut AS (
      SELECT rid, 'assign' AS kind, 0 AS place, 12 AS least, string_split_regex(text, '{_ASSIGN}') AS gaps,
             regexp_extract_all(text, '{_ASSIGN}') AS hits, regexp_extract_all(text, '{_ASSIGN}', 2) AS vals FROM d
      UNION ALL
      SELECT rid, 'access', 1, 18, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'),
             regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
      UNION ALL
      SELECT rid, 'hex', 2, 16, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'),
             regexp_extract_all(text, '[0-9a-f]+') FROM d
    ),
    one AS (
      SELECT rid, kind, place, least, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS val,
             generate_subscripts(hits, 1) AS i
      FROM cut WHERE len(hits) > 0
    ),
    placed AS (
      SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM one
    ),
    found AS (
      SELECT rid, kind, place, stop - length(hit) AS start, stop FROM placed WHERE length(val) >= least
    ),
    summed AS (
      SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
      FROM found GROUP BY rid
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN summed USING (rid)
    """,
)
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents"))
    number = [secrets.span_count(F.col("found"), r.kind).alias(f"n_{r.kind}") for r in secrets.RULES]
    listed = secrets.span_list(F.col("found"))
    return found.select("doc_id", *number, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """Content of a public rank file, and the pattern that goes with it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


@query("op4_byte_bpe")  # SQL has no merges by rank; tests compare it with a public library
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = rank_file()
    return bpe.decode_digests(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)


#: The rules asked for.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


@query(
    "op7_url_filter",
    r"""
    WITH cut AS (
      SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
    ),
    parts AS (
      SELECT rid, page_id,
             coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM cut
    ),
    rules(h, p, verdict) AS (
      VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ),
    won AS (
      SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(rules.verdict, length(h || p)) AS verdict
      FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      GROUP BY rid
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN won USING (rid)
    """,
)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Machine:
    """Fitted to the labelled documents that are not held out."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 3) != 1)


@query("op3_toxicity")  # a fitted model; tests measure it on the rows held out
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxic_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op9_quality")  # a fitted model; tests measure it on the rows held out
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op8_suffix_dedup")  # too slow in SQL over whole tables; tests compare it with brute force
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents"))


@query("op1_hamming_neighbours")  # approximate; tests measure the share of true neighbours found
def op1_hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_bagminhash")  # SQL over all pairs is too slow; tests compare it with brute force
def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query(
    "op11_seed_extend",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    starts AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
    windows AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM starts),
    least AS (SELECT win, min(doc_id) AS first_id FROM windows GROUP BY win),
    marked AS (
      SELECT rid, i, 1 AS m FROM windows JOIN least USING (win) WHERE coalesce(first_id < doc_id, first_id IS NOT NULL)
    ),
    judged AS (
      SELECT rid, i, word, max(m) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS covered
      FROM words LEFT JOIN marked USING (rid, i)
    ),
    summed AS (
      SELECT rid, count(covered) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (covered IS NULL) AS kept FROM judged GROUP BY rid
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN summed USING (rid)
    """,
)
def op11_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes in SQL, bit by bit."""
    digit = "(instr('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1)"
    byte = f"16 * {digit.format(text, '2 * i + 1')} + {digit.format(text, '2 * i + 2')}"
    bits = f"flatten(list_transform(range(0, strlen({text})), lambda i: [CAST({byte} AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, o: {step}), 4294967295)"


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the rebuilt conversations: some turns of the family's first, then what follows as many of their own."""
    pieces = settle(trie.ordered_pieces(table(spark, sf_dir, "conversations")), "conversations")
    own = F.col("conv_id")
    starts = pieces.filter("start < 8").groupBy(own.alias("base")).agg(trie.join_strings(F.collect_list(F.struct("start", "data"))).alias("data"))
    borrowed = F.pmod(F.crc32(own.cast("string")), F.lit(9)).cast("long")
    family = pieces.select("conv_id").distinct().select("conv_id", (own - own % 5).alias("base"), borrowed.alias("h"))
    head = trie.cut(F.coalesce("data", F.lit(b"")), F.lit(0), F.col("h"))
    heads = settle(family.join(starts, "base", "left").select("conv_id", "h", head.alias("head")), "family")
    taken = (F.octet_length("head") / trie.RECORD).cast("long")
    kept = trie.cut(F.col("data"), F.greatest(F.col("h") - F.col("start"), F.lit(0)))
    later = pieces.join(heads, "conv_id").select(
        "conv_id", (F.greatest("start", "h") - F.col("h") + taken).alias("start"), kept.alias("data")
    )
    return heads.select("conv_id", F.lit(0).cast("long").alias("start"), F.col("head").alias("data")).unionByName(later.filter("octet_length(data) > 0"))


@query(
    "op13_prefix_trie",
    f"""
    WITH ordered AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r,
             coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL
    ),
    convs AS (
      SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM ordered)
    ),
    turns AS (
      SELECT c.conv_id, o.r, 0 AS own, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.r <= c.h
      UNION ALL
      SELECT c.conv_id, o.r, 1, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.r > c.h
    ),
    placed AS (
      SELECT conv_id, row_number() OVER w AS d, strlen(text) AS size, md5(strlen(role) || ':' || role || text) AS m
      FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY own, r)
    ),
    paths AS (
      SELECT conv_id, d, size, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, count(*) OVER (PARTITION BY conv_id) AS turns FROM placed
      UNION ALL
      SELECT c.conv_id, 0, 0, '', count(p.d) FROM convs c LEFT JOIN placed p USING (conv_id) GROUP BY c.conv_id
    ),
    nodes AS (
      SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = d), '')) AS ends_sha256
      FROM paths GROUP BY path, d
    ),
    related AS (
      SELECT n.path, n.d, coalesce(p.conv_id, NULL) AS parent_conv_id, n.conv_id, n.n_convs, n.size, n.ends_sha256,
             (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.path[1:32 * n.d] = n.path) AS n_children
      FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:32 * (n.d - 1)]
    ),
    above AS (SELECT path[1:32 * a] AS path, a AS d, n_children, (n_convs - 1) * size AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM related)),
    below AS (SELECT path, d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path, d)
    SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
    FROM related JOIN below USING (path, d)
    """,
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.with_digests(*trie.prefix_trie(rebuilt(spark, sf_dir)))


@query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE runs AS (
      SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS raw FROM documents
    ),
    lowered AS (
      SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
      FROM runs WHERE length(raw) >= 6
    ),
    once AS (SELECT id || w AS t, w, count(*) AS n FROM lowered GROUP BY ALL),
    hashed AS (SELECT w, n, {crc32_sql("t")} AS h FROM once),
    changed AS (
      SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed
    ),
    vocab AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ),
    cut AS (
      SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)
    ),
    near AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
      UNION
      SELECT c.word, v.word, v.n FROM cut c JOIN vocab v ON v.word = c.rest
      UNION
      SELECT v.word, c.word, c.n FROM cut c JOIN vocab v ON v.word = c.rest
    ),
    best AS (
      SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
    ),
    formed AS (
      SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
      FROM vocab v LEFT JOIN best USING (word)
    ),
    ways AS (
      SELECT word, word AS root, 0 AS steps FROM formed
      UNION ALL
      SELECT w.word, f.form, w.steps + 1 FROM ways w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL
    ),
    ends AS (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
    """,
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), spelling.drop_letters))
