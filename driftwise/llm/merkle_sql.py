"""DuckDB SQL of the Merkle manifest: one CTE per level, windows for the siblings of a run."""

#: Levels below a subroot and above it that the SQL spells out: 8 ** 7 documents of a language, 8 ** 3 languages.
LOW, HIGH = 7, 3

#: CRC-32 of a string of ASCII characters, by the table of the reflected polynomial 0xEDB88320.
CRC32 = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i)))
"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, where ``crc_table`` is joined; null if the text is null."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR)))::VARCHAR || ':' || CAST({x} AS VARCHAR), '-')"


def _levels(base: str, group: str, levels: int, prefix: str) -> str:
    """CTEs ``prefix0..levels``: nodes (group, rank, n, h, pre, post); pre and post are the digests beside the node in its run."""
    out = []
    for i in range(levels + 1):
        source = base if i == 0 else f"""
          SELECT {group}, rank // 8 AS rank, any_value((n + 7) // 8) AS n,
                 CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY rank)) ELSE any_value(h) END AS h
          FROM {prefix}{i - 1} GROUP BY {group}, rank // 8"""
        run = f"PARTITION BY {group}, rank // 8 ORDER BY rank ROWS BETWEEN"
        out.append(f"""{prefix}{i} AS (
          SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
                 coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post
          FROM ({source}))""")
    return ",\n".join(out)


def _sql() -> str:
    sides, joins = [], []
    steps = [(f"a{i}", f"low{i}", f"a{i}.key = l.key AND a{i}.rank = l.rank // {8**i}") for i in range(LOW)]
    steps += [(f"b{i}", f"high{i}", f"b{i}.rank = s.rank // {8**i}") for i in range(HIGH)]
    for alias, name, on in steps:
        joins.append(f"JOIN {name} {alias} ON {on}")
        sides.append(f"{alias}.pre || {alias}.post")
    chain, before = [], "checked"  # a column per step: each names the one before twice
    for k, (alias, _, _) in enumerate(steps):
        chain.append(f"CASE WHEN {alias}n > 1 THEN sha256({alias}pre || {before} || {alias}post) ELSE {before} END AS f{k}")
        before = f"f{k}"
    wide = ", ".join(f"{a}.n AS {a}n, {a}.pre AS {a}pre, {a}.post AS {a}post" for a, _, _ in steps)
    body = f"SELECT l.*, t.h AS subroot, r.h AS root, sha256({' || '.join(sides)}) AS proof_sha256, {wide} FROM leaves l JOIN low{LOW} t ON t.key = l.key JOIN subroots s ON s.key = l.key {' '.join(joins)} JOIN high{HIGH} r ON true"
    for c in chain:
        body = f"SELECT *, {c} FROM ({body})"
    return f"""
    WITH {CRC32},
    raw AS (
      SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS key,
             {_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} AS head, text,
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low_text,
             {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS tampered
      FROM documents, crc_table),
    digests AS (
      SELECT doc_id, key, sha256(head || {_field('text')}) AS h,
             CASE WHEN tampered THEN sha256(head || {_field('low_text')}) ELSE sha256(head || {_field('text')}) END AS checked FROM raw),
    leaves AS (
      SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h, checked) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM digests),
    {_levels("SELECT key, rank, n, h FROM leaves", "key", LOW, "low")},
    subroots AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS rank, count(*) OVER () AS n FROM low{LOW}),
    {_levels("SELECT 0 AS g, rank, n, h FROM subroots", "g", HIGH, "high")}
    SELECT doc_id, h AS leaf, subroot, root, proof_sha256, {before} AS folded_root, {before} = root AS verified
    FROM ({body})
    """


MANIFEST_SQL = _sql()
