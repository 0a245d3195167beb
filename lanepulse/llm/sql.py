"""SQL that recomputes the queries of this subpackage, where SQL can express them."""

URLS = r"""
WITH parts AS (
  SELECT page_id, instr(url, '://') AS at, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id, rest,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
canon AS (
  SELECT page_id, host, path,
         CASE WHEN rest IS NOT NULL THEN
           concat(regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', ''), regexp_replace(path, '/+$', ''), '?',
                  array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref)='))), '&')) END AS canonical
  FROM split),
rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
listed AS (
  SELECT DISTINCT canonical FROM canon
  WHERE canonical IS NOT NULL AND regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')),
ruled AS (
  SELECT c.*, (SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM rules r
               WHERE (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path)) AS best
  FROM canon c)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict, r.canonical
FROM ruled r LEFT JOIN listed l ON r.canonical = l.canonical
"""


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII string, bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), lambda c, i: {bit}, xor(crc, ascii(ch)::BIGINT))"
    return f"xor(list_reduce(string_split({text}, ''), lambda crc, ch: {byte}, 4294967295::BIGINT), 4294967295)"


def _folded(levels: int, leaf: str) -> str:
    for k in range(levels):
        leaf = f"CASE WHEN l{k} IS NULL THEN {leaf} ELSE sha256(concat(l{k}, {leaf}, r{k})) END"
    return leaf


def _tree(prefix: str, source: str, levels: int) -> str:
    """CTEs <prefix>0.. of nodes (g, rank, digest) per level; a group ends with one node."""
    parts = [f"{prefix}0 AS (SELECT g, rank, digest, count(*) OVER (PARTITION BY g) AS n FROM {source})"]
    for k in range(levels):
        parts.append(
            f"{prefix}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ("
            f"SELECT p.g, p.rank // 8 AS rank, sha256(string_agg(p.digest, '' ORDER BY p.rank)) AS digest "
            f"FROM {prefix}{k} p WHERE p.n > 1 GROUP BY p.g, p.rank // 8))")
    return ",\n".join(parts)


def _siblings(prefix: str, row: str, levels: int, first: int) -> tuple[str, str]:
    """Columns l<k>, r<k>, digests left and right of the row's ancestor in its run, and the
    joins with the runs."""
    columns, joins = [], []
    for k in range(levels):
        run, at = f"{prefix}r{k}", f"({row}.rank // {8 ** k}) % 8"
        columns.append(f"array_to_string({run}.run[1:{at}], '') AS l{first + k}")
        columns.append(f"array_to_string({run}.run[{at} + 2:], '') AS r{first + k}")
        joins.append(f"LEFT JOIN (SELECT g, rank // 8 AS bucket, list(digest ORDER BY rank) AS run FROM {prefix}{k} "
                     f"WHERE n > 1 GROUP BY ALL) {run} ON {run}.g IS NOT DISTINCT FROM {row}.g "
                     f"AND {run}.bucket = {row}.rank // {8 ** (k + 1)}")
    return ", ".join(columns), " ".join(joins)


def _manifest(levels: int = 10, upper: int = 3) -> str:
    """Trees of up to 8^levels rows a language and 8^upper languages."""
    def leaf(text):
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(concat({}))".format(", ".join(
            f"coalesce(concat(strlen({f}::VARCHAR), ':', {f}::VARCHAR), '-')" for f in fields))

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    every = levels + upper
    own, own_runs = _siblings("t", "x", levels, 0)
    more, more_runs = _siblings("u", "s", upper, levels)
    proof = ", ".join(f"coalesce(l{k}, ''), coalesce(r{k}, '')" for k in range(every))
    return f"""
WITH leaves AS (
  SELECT doc_id, lang AS g, {leaf('text')} AS digest,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS seen
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank FROM leaves),
{_tree('t', 'ranked', levels)},
subroots AS (SELECT 0 AS g, lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM (
  {' UNION ALL '.join(f'SELECT g AS lang, digest FROM t{k} WHERE n = 1' for k in range(levels + 1))})),
{_tree('u', 'subroots', upper)},
root AS ({' UNION ALL '.join(f'SELECT digest FROM u{k} WHERE n = 1' for k in range(upper + 1))}),
above AS (SELECT s.lang, s.digest AS subroot, {more} FROM subroots s {more_runs}),
paths AS (
  SELECT x.doc_id, x.digest AS leaf, x.seen, a.* EXCLUDE (lang), (SELECT digest FROM root) AS root,
         {own}
  FROM ranked x JOIN above a ON x.g IS NOT DISTINCT FROM a.lang {own_runs})
SELECT doc_id, leaf, subroot, root, sha256(concat({proof})) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, {_folded(every, 'seen')} AS folded_root FROM paths)
"""


def oracle_sql():
    return {"op8_url_filter": URLS, "op13_manifest": _manifest()}
