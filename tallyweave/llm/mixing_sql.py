"""The mix of ``tallyweave.llm.mixing`` as SQL."""

from __future__ import annotations

from tallyweave.llm.mixing import BLOCK_WORDS, PASSES, PRIME


def _hash(key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT)"


def _permutation() -> list[tuple[str, str]]:
    """The permutation's columns one after the other; the last one is the block."""
    steps, last = [("side", "CAST(floor(sqrt(blocks::DOUBLE)) AS BIGINT)"), ("width", "blocks // side")], "i"
    for j in range(PASSES):
        inner = f"((key * {2 * j + 3} + {j * 12345}) % 1073741824)"
        mixed = lambda x, c=inner: f"((({x} % 1073741824 + {c}) * ({x} % 1073741824 + {c})) % {PRIME})"
        steps += [
            (f"t{j}", f"(({last} + (key * {j + 7}) % blocks) % blocks)"),
            (f"l{j}", f"(t{j} // width + {mixed(f'(t{j} % width)')}) % side"),
            (f"r{j}", f"(t{j} % width + {mixed(f'l{j}')}) % width"),
            (f"i{j}", f"CASE WHEN t{j} < side * width THEN l{j} * width + r{j} ELSE t{j} END"),
        ]
        last = f"i{j}"
    return steps


def mix_sql(seed: str = "mix", documents: str = "documents") -> str:
    steps, last = "", "rounds"
    for k, (name, step) in enumerate(_permutation()):
        steps += f", step{k} AS (SELECT *, {step} AS {name} FROM {last})\n"
        last = f"step{k}"
    w = BLOCK_WORDS
    return rf"""
WITH sizes AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM {documents}
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM by_source
), weighted AS (
  SELECT *, [5, 2, 1][sid % 3 + 1] AS weight, source_size * 2 AS cap FROM ranked
), filled AS (
  SELECT *, cap::DOUBLE / weight AS fill FROM weighted
), levels AS (
  SELECT *, row_number() OVER (ORDER BY fill, sid) AS place,
         sum(cap) OVER (ORDER BY fill, sid) - cap AS full_up,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY fill, sid) + weight AS open_up,
         sum(source_size) OVER () AS all_size
  FROM filled
), common AS (
  SELECT arg_min(level, place) AS common FROM (
    SELECT place, fill, (all_size::DOUBLE * 1.5::DOUBLE - full_up::DOUBLE) / open_up::DOUBLE AS level FROM levels) WHERE level <= fill
), targets AS (
  SELECT source, sid, source_size, least(cap::DOUBLE, common * weight) AS target,
         CAST(ceil(source_size::DOUBLE / {w}) AS BIGINT) AS blocks FROM filled, common
), quotas0 AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE
    least(blocks * 2, CAST(floor(blocks * target / source_size + 0.5::DOUBLE) AS BIGINT)) END AS quota FROM targets
), quotas1 AS (
  SELECT *, CAST(sum(quota) OVER (ORDER BY sid) AS BIGINT) AS high, CAST(sum(quota) OVER () AS BIGINT) AS slots FROM quotas0
), draws AS (
  SELECT id AS slot, id // 16384 AS shard, {_hash(f"'{seed}:slot:' || id")} % greatest((SELECT max(slots) FROM quotas1), 1) AS point
  FROM range(coalesce((SELECT max(slots) FROM quotas1), 0)) r(id)
), drawn AS (
  SELECT slot, shard, sid, quota, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS n
  FROM draws JOIN quotas1 ON point >= high - quota AND point < high
), got AS (
  SELECT q.sid, q.quota, q.blocks, count(d.slot) AS got FROM quotas1 q LEFT JOIN drawn d USING (sid) GROUP BY ALL
), gaps AS (
  SELECT *, sum(greatest(got - quota, 0)) OVER (ORDER BY sid) - greatest(got - quota, 0) AS over_first,
         sum(greatest(quota - got, 0)) OVER (ORDER BY sid) AS gap_high FROM got
), dealt AS (
  SELECT sid, blocks, n FROM drawn WHERE n < quota
  UNION ALL
  SELECT g.sid, g.blocks, g.got + m.point - (g.gap_high - (g.quota - g.got))
  FROM (SELECT CAST(over_first + n - drawn.quota AS BIGINT) AS point FROM drawn JOIN gaps USING (sid) WHERE n >= drawn.quota) m
  JOIN gaps g ON g.quota > g.got AND m.point >= g.gap_high - (g.quota - g.got) AND m.point < g.gap_high
), rounds AS (
  SELECT sid, blocks, CAST(n AS BIGINT) % blocks AS i, {_hash(f"'{seed}:round:' || sid || ':' || (CAST(n AS BIGINT) // blocks)")} % {PRIME} AS key FROM dealt
)
{steps}, times AS (
  SELECT sid, i{PASSES - 1} AS block, count(*) AS times FROM {last} GROUP BY ALL
), placed AS (
  SELECT rid, doc_id, size, sid, source_size, target,
         CAST(sum(size) OVER (PARTITION BY sid ORDER BY {_hash(f"'{seed}:' || coalesce(doc_id::VARCHAR, 'null')")}, doc_id, size, rid) AS BIGINT) - size AS start
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source
), pieces AS (
  SELECT *, unnest(range(start // {w}, (start + size - 1) // {w} + 1)) AS block FROM placed WHERE size > 0
), taken AS (
  SELECT rid, sum((least(size, (block + 1) * {w} - start) - greatest(0, block * {w} - start)) * coalesce(times, 0)) AS taken
  FROM pieces LEFT JOIN times USING (sid, block) GROUP BY rid
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN taken USING (rid)
"""
