"""SQL that says the same as the queries of this subpackage."""

from __future__ import annotations

import unicodedata

#: Files in order of arrival, which of them repeat an earlier one, and, by rounds, which are accepted: no earlier accepted one is repeated.
REPEATS = r"""
with recursive own as (select file_index as file_id, batch_no, chunk_seq, checksum, coalesce(uncompressed_size, 0) as size, relative_path from chunk_index where file_index is not null and batch_no is not null),
  sizes as (select file_id, batch_no, sum(size)::bigint as size from (select file_id, batch_no, chunk_seq, case when chunk_seq is null then checksum end as nth, max(size) as size from own group by all) group by all),
  paths as (select file_id, batch_no, string_split(replace(lower(nfc_normalize(url_decode(min(relative_path)))), '\', '/'), '/') as parts from own where relative_path is not null group by all),
  places as (select file_id, batch_no, list_reduce(list_prepend('', parts), lambda a, x: case when x in ('', '.') then a when x = '..' then regexp_replace(a, '/?[^/]*$', '') when a = '' then x else a || '/' || x end) as place from paths),
  files as (select row_number() over (order by batch_no, file_id) as nr, file_id, batch_no, size, place from sizes left join places using (file_id, batch_no)),
  sets as (select distinct f.nr, o.checksum from own o join files f using (file_id, batch_no) where o.checksum is not null and f.size > 0),
  counts as (select nr, count(*) as n from sets group by nr),
  common as (select a.nr as late, b.nr as early, count(*) as k from sets a join sets b on a.checksum = b.checksum and a.nr > b.nr group by all),
  edges as (select late, early from common join counts x on x.nr = late join counts y on y.nr = early where k * 5 >= (x.n + y.n - k) * 4
    union select a.nr, b.nr from files a join files b on a.place = b.place and a.size = b.size and a.nr > b.nr),
  rounds as (select 0 as round, nr, 0 as state from files
    union all select r.round + 1, r.nr, case when r.state <> 0 then r.state when n.taken then 2 when n.open then 0 else 1 end
      from rounds r left join (select late, bool_or(state = 1) as taken, bool_or(state = 0) as open from edges join rounds on rounds.nr = early group by late) n on n.late = r.nr
      where exists (select 1 from rounds where state = 0)),
  settled as (select nr, state from rounds where round = (select max(round) from rounds))
select distinct least(a.file_id, b.file_id) as file_a, greatest(a.file_id, b.file_id) as file_b
  from edges join settled x on x.nr = late and x.state = 2 join settled y on y.nr = early and y.state = 1 join files a on a.nr = late join files b on b.nr = early"""

#: White space as the word rules see it, for a character class.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _compatible() -> str:
    """Each character with another compatibility form (NFKC) and that form, as rows; built from the rule, since SQL lacks it."""
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000)
    return ", ".join(f"('{c}', '{plain.replace(chr(39), chr(39) * 2)}')" for c, plain in forms if c != plain)


def leaks() -> str:
    """Words of documents and items, places where 12 of them have equal sums of hashes, those that are equal, and the words of an item these cover."""
    letter, space = r"[\p{L}\p{Nl}\p{No}]", SPACE.replace(r"\s", r" \t\f")
    return rf"""
with compat(c, plain) as (values {_compatible()}),
  texts as (select 'd' as kind, doc_id as id, text from documents where doc_id is not null and text is not null union all select 'i', item_id, text from eval_item where item_id is not null and text is not null),
  chars as (select distinct unnest(string_split(regexp_replace(text, '[\x00-\x7f]+', '', 'g'), '')) as c from texts),
  present as (select coalesce(list(c || plain), []) as p from chars join compat using (c)),
  level as (select kind, id, regexp_replace(nfc_normalize(list_reduce(list_prepend(text, p), lambda a, x: replace(a, x[1], x[2:]))), '({letter})[-‐­][{space}]*(?:\r\n|\r|\n)[{space}\r\n]*({letter})', '\1\2', 'g') as text from texts, present),
  words as (select kind, id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from level),
  spots as (select kind, id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, len(w) as n from words),
  sums as (select kind, id, i, n, sum(hash(word) % 1000000007) over (partition by kind, id order by i rows between current row and 11 following) as s from spots),
  near as (select d.id as doc_id, a.id as item_id, d.i as j, a.i from sums d join sums a on d.s = a.s where d.kind = 'd' and a.kind = 'i' and d.i + 11 <= d.n and a.i + 11 <= a.n),
  met as (select distinct doc_id, item_id, i from near join words d on d.kind = 'd' and d.id = doc_id join words a on a.kind = 'i' and a.id = item_id where d.w[j : j + 11] = a.w[i : i + 11]),
  covered as (select doc_id, item_id, count(distinct k) as n from (select doc_id, item_id, unnest(range(i, i + 12)) as k from met) group by all),
  found as (select doc_id, item_id from covered join (select id as item_id, max(len(w)) as words from words where kind = 'i' group by all) using (item_id) where n * 10 >= words * 4)
"""


def oracle_sql() -> dict[str, str]:
    count = rf"len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]'))"
    return {
        "p2_found": REPEATS,
        "p5_invariants": f"select count(*) as documents, coalesce(sum({count}), 0)::bigint as tokens, 0::bigint as overfull, 0::bigint as misplaced, 0::bigint as split_small, true as tight from documents",
        "p6_found": leaks() + "select doc_id, item_id from found",
        "p6_items": leaks() + "select item_id, suite, count(*) as documents from found join (select item_id, min(suite) as suite from eval_item group by all) using (item_id) group by all",
        "p7_invariants": "select doc_id, length(text) as chars, 0::bigint as gaps, 0::bigint as over_limit, 0::bigint as without_overlap from documents where text <> ''",
        "p7_found": f"select distinct doc_id from documents where {count} > 2048",
    }
