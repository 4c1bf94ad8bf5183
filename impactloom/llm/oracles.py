"""SQL of the Merkle manifest and of importance resampling, level by level and feature by feature."""

from __future__ import annotations

def _nibble(x: int) -> int:
    """What the lowest four bits of a CRC-32 register become."""
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


_NIBBLES = [_nibble(x) for x in range(16)]



def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes."""
    table = "[" + ", ".join(f"{x}::BIGINT" for x in _NIBBLES) + "]"
    half = "xor(({0}) >> 4, {1}[(({0}) & 15) + 1])"
    step = half.format(half.format("xor(c, b)", table), table)
    each = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {each}), lambda c, b: {step}), 4294967295::BIGINT)"


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def merkle_sql(levels: int = 8, group_levels: int = 4) -> str:
    """Trees of up to 16 ** ``levels`` rows a source and 16 ** ``group_levels`` sources."""

    def leaf(text: str) -> str:
        fields = [f"{f}::VARCHAR" for f in ("doc_id", "source", "lang", "n_chars")] + [text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"

    ctes = [
        f"""base AS (SELECT doc_id, coalesce('+' || source, '') AS g, {leaf("text")} AS leaf,
  CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(LOWER_SQL.format("text"))} END AS tampered FROM documents)""",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base)",
        "n0 AS (SELECT g, i, leaf AS d FROM a0)",
    ]

    def tree(nodes: str, group: str, depth: int) -> str:
        """Nodes of each level with the siblings before and behind them; the last is the top."""
        for k in range(depth):
            now, up = f"{nodes}{k}", f"{nodes}{k + 1}"
            w = f"OVER (PARTITION BY {group}, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            ctes.append(
                f"""{now}_s AS (SELECT {group}, i, d, n > 1 AS many, array_to_string(s[: i % 16], '') AS before, array_to_string(s[i % 16 + 2 :], '') AS after
  FROM (SELECT {group}, i, d, count(*) OVER (PARTITION BY {group}) AS n, list(d) {w} AS s FROM {now}))"""
            )
            ctes.append(f"{up} AS (SELECT {group}, i // 16 AS i, CASE WHEN bool_or(many) THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {now}_s GROUP BY {group}, i // 16)")
        return f"{nodes}{depth}"

    top = tree("n", "g", levels)
    ctes.append(f"m0 AS (SELECT '' AS h, row_number() OVER (ORDER BY g) - 1 AS i, d FROM {top})")
    ctes.append(f"roots AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS j FROM {top})")
    last = tree("m", "h", group_levels)
    ctes.append("w0 AS (SELECT a0.*, '' AS proof, coalesce(tampered, leaf) AS folded FROM a0)")
    for k in range(levels):
        ctes.append(
            f"""w{k + 1} AS (SELECT w.* REPLACE (CASE WHEN many THEN proof || before || after ELSE proof END AS proof, CASE WHEN many THEN sha256(before || folded || after) ELSE folded END AS folded)
  FROM w{k} w JOIN n{k}_s s ON s.g = w.g AND s.i = w.i // {16**k})"""
        )
    ctes.append(f"v0 AS (SELECT w.*, subroot, j FROM w{levels} w JOIN roots USING (g))")
    for k in range(group_levels):
        ctes.append(
            f"""v{k + 1} AS (SELECT v.* REPLACE (CASE WHEN many THEN proof || before || after ELSE proof END AS proof, CASE WHEN many THEN sha256(before || folded || after) ELSE folded END AS folded)
  FROM v{k} v JOIN m{k}_s s ON s.i = v.j // {16**k})"""
        )
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM v{group_levels}, {last}"""
    )


def resample_sql(percent: int = 25, least: int = 20, seed: int = 7, buckets: int = 10_000) -> str:
    split = f"list_filter(regexp_split_to_array({LOWER_SQL.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    pairs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {split} AS w FROM documents),
f AS (SELECT r, unnest({pairs}) AS x FROM docs),
b AS (SELECT unnest({pairs}) AS x FROM (SELECT {split} AS w FROM benchmark)),
named AS (SELECT x, ({crc32_sql("x")} % {buckets})::INT AS k FROM (SELECT x FROM f UNION SELECT x FROM b)),
fs AS (SELECT k, count(*) AS s FROM f JOIN named USING (x) GROUP BY k),
ft AS (SELECT k, count(*) AS t FROM b JOIN named USING (x) GROUP BY k),
total AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM fs) + {buckets} AS s, (SELECT coalesce(sum(t), 0)::DOUBLE FROM ft) + {buckets} AS t),
gains AS (SELECT k, floor(1000 * ln((coalesce(ft.t, 0) + 1)::DOUBLE * total.s / ((coalesce(fs.s, 0) + 1)::DOUBLE * total.t)))::BIGINT AS gain FROM fs FULL JOIN ft USING (k), total),
sums AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN named USING (x) JOIN gains USING (k) GROUP BY r),
scored AS (SELECT doc_id, r, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN sums USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () * {percent} // 100 AS drawn FROM scored WHERE n_words >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN able USING (r)"""
