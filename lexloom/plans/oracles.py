"""DuckDB SQL of the queries that SQL can express over whole tables. Not given: what needs an automaton, a trained model, a parser
with state, or a quadratic comparison; those are tested against brute force."""

from __future__ import annotations

# Fixed values, written out here so that a wrong entry of the engine's own tables does not agree with itself.
FOLDED = {
    "àáâãäåāăą": "a",
    "çćĉċč": "c",
    "ďđ": "d",
    "èéêëēĕėęě": "e",
    "ƒ": "f",
    "ĝğġģ": "g",
    "ĥħ": "h",
    "ìíîïĩīĭįı": "i",
    "ĵ": "j",
    "ķ": "k",
    "ĺļľŀł": "l",
    "ñńņňŉ": "n",
    "òóôõöøōŏő": "o",
    "ŕŗř": "r",
    "śŝşš": "s",
    "ţťŧ": "t",
    "ùúûüũūŭůűų": "u",
    "ŵ": "w",
    "ýÿŷ": "y",
    "źżž": "z",
}
FOLD_FROM = "".join(FOLDED)
FOLD_TO = "".join(to * len(chars) for chars, to in FOLDED.items())
QUOTES, DASHES = "‘’‛′", "‐‑‒–—−"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MEDIA_TYPES = {
    "text/html": "html htm",
    "text/css": "css",
    "text/javascript": "js",
    "application/json": "json",
    "text/xml": "xml",
    "text/plain": "txt",
    "image/png": "png",
    "image/jpeg": "jpg jpeg",
    "image/gif": "gif",
    "image/bmp": "bmp",
    "image/webp": "webp",
    "image/svg+xml": "svg",
    "image/x-icon": "ico",
    "audio/mpeg": "mp3",
    "audio/wav": "wav",
    "audio/ogg": "ogg oga spx",
    "audio/flac": "flac",
    "audio/aac": "aac",
    "audio/m4a": "m4a",
    "video/mp4": "mp4",
    "video/webm": "webm",
    "font/ttf": "ttf",
    "font/otf": "otf",
    "font/woff": "woff",
    "font/woff2": "woff2",
    "application/vnd.ms-fontobject": "eot",
    "application/pdf": "pdf",
}
CONTENT_TYPES = {ext: kind for kind, exts in MEDIA_TYPES.items() for ext in exts.split()}
OCTET_STREAM = "application/octet-stream"
RESOURCE_EXTENSIONS = "jpg jpeg png gif bmp webp svg ico css js wav mp3 ogg oga flac aac m4a mp4 webm ttf otf woff woff2 eot pdf".split()
IRREGULAR = {
    "go": "went gone",
    "do": "did done",
    "be": "was were is are am",
    "good": "better best",
    "bad": "worse worst",
    "child": "children",
    "mouse": "mice",
    "tooth": "teeth",
    "foot": "feet",
    "man": "men",
    "woman": "women",
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def low(c: str) -> str:
    """Lower case with the final sigma, which DuckDB's lower() has not."""
    return rf"lower(regexp_replace({c}, '(\p{{L}})Σ($|[^\p{{L}}])', '\1ς\2', 'g'))"


def fold(c: str) -> str:
    return f"replace(replace(replace(translate({c}, {q(FOLD_FROM)}, {q(FOLD_TO)}), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss')"


def norm(c: str) -> str:
    return rf"trim(regexp_replace({fold(low(c))}, '[^\p{{L}}\p{{N}}'']+', ' ', 'g'))"


def nocase(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


WORDS = "words as (select distinct word from query_form where word is not null)"
PREFIXES = f"prefixes as (select distinct substring(canonical, 1, 4) as prefix from ref_headword), wanted as (select prefix, {norm('prefix')} as lo from prefixes where {norm('prefix')} <> '')"


def plain(w: str, size: int, bad: str, first: str) -> str:
    return f"(strlen({w}) <= {size} and {w} <> '' and not regexp_matches({w}, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]') and not regexp_matches({w}, '{bad}') and not regexp_matches({w}, '{first}'))"


SUGGEST = plain("text", 40, r"[/\\<>]", "^[-.0-9]")
FTS = plain("text", 50, r"[@<>/\\]", "^[-.0-9]")
FUZZY = plain("text", 64, r"[/\\<>]", "^[-.@0-9]")
DISPLAY = r"(strlen(text) <= 80 and text <> '' and not regexp_matches(text, '^[\\/@.]') and not regexp_matches(text, '[<>]'))"
RESOURCE = r"regexp_matches(text, '^[\\/]')"
TARGET = r"regexp_replace(regexp_replace(regexp_extract(body, '^\x{FEFF}?@@@LINK=([^\n]*)', 1), '[\x00-\x1F\x7F-\x{9F}]', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
MIME = "coalesce(map([" + ",".join(q(k) for k in CONTENT_TYPES) + "],[" + ",".join(q(v) for v in CONTENT_TYPES.values()) + rf"])[lower(regexp_extract(text, '\.([^./\\]+)$', 1))], '{OCTET_STREAM}')"
KEYED = f"keyed as (select dict_id, id, 0 as kind, text as key from mdx_index union all select dict_id, id, 1, {nocase('text')} from mdx_index union all select dict_id, id, 2, normalized from mdx_index where normalized is not null)"
CASCADE = f"""{WORDS}, {KEYED}, asked as (select word, 0 as kind, word as key from words union all select word, 1, {nocase('word')} from words union all select word, 2, word from words),
 hits as (select word, dict_id, kind, id from asked join keyed using (kind, key)),
 cascade as (select word, dict_id, kind, id from hits qualify row_number() over (partition by word, dict_id order by kind, id) = 1)"""
#: Rows a redirect means: same dictionary, by text, else by the normalisation, lowest id first; dead ones are no links.
LINKS = f"""refs as (select section_id, min(index_id) as index_id, dict_id, min(fetched_at) as fetched_at, {TARGET} as target from aggregate_section where {TARGET} <> '' group by section_id, dict_id, {TARGET}),
 by_text as (select dict_id, text, min(id) as id from mdx_index group by all), by_norm as (select dict_id, normalized, min(id) as id from mdx_index where normalized <> '' group by all),
 meant as (select r.*, coalesce(t.id, n.id) as target_id from refs r left join by_text t on t.dict_id = r.dict_id and t.text = r.target left join by_norm n on n.dict_id = r.dict_id and n.normalized = {norm('r.target')}),
 links as (select index_id as child, arg_min(m.target_id, m.section_id) as parent from meant m join mdx_index i on i.id = m.target_id
  where not coalesce(i.deleted_at <= m.fetched_at, false) and i.indexed_at <= m.fetched_at and index_id is not null group by index_id)"""
FILTER = "list_filter(list_transform(string_split(coalesce(dicts, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
HITS = f"""{PREFIXES}, hits as (select w.prefix, i.dict_id, i.id, i.text from wanted w join mdx_index i on starts_with(i.normalized, w.lo) where length(i.text) < 50)"""
TOKENS = rf"regexp_extract_all({fold(low('text'))}, '[\p{{L}}\p{{N}}\p{{Co}}]+')"
POSTINGS = f"docs as (select dict_id, id, {TOKENS} as ts from mdx_index where {FTS}), posts as (select dict_id, id, len(ts) as dl, unnest(ts) as token from docs), postings as (select dict_id, id, dl, token, count(*) as tf from posts group by all)"

#: English base forms of the words of a table seeds(word, n, s): word, n, l, with null and repeated ones among l.
FORMS = "map([" + ",".join(q(w) for ws in IRREGULAR.values() for w in ws.split()) + "],[" + ",".join(q(k) for k, ws in IRREGULAR.items() for _ in ws.split()) + "])[w]"


def stem(n: int) -> str:
    return f"left(w, length(w) - {n})"


def undoubled(x: str) -> str:
    return f"case when length({x}) > 1 and right({x}, 1) = substring({x}, length({x}) - 1, 1) and right({x}, 1) between 'b' and 'z' then left({x}, length({x}) - 1) end"


def ended(suffix: str, longer: int, value: str) -> str:
    return f"case when w like '%{suffix}' and length(w) > {longer} then {value} end"


BARE = "regexp_replace(seed, '^ +| +$', '', 'g')"
LEMMAS = f"""lemmas as (select word, n, case when regexp_full_match(s, '[A-Za-z0-9''\\-]+') then [w, {FORMS}, case when w like '%''s' then {stem(2)} end, case when w like '%s''' then {stem(2)} end,
 {ended('ies', 4, stem(3) + " || 'y'")}, {ended('ves', 4, stem(3) + " || 'f'")}, {ended('ves', 4, stem(3) + " || 'fe'")}, {ended('es', 3, stem(2))}, {ended('s', 3, stem(1))},
 {ended('ing', 5, stem(3))}, {ended('ing', 5, undoubled(stem(3)))}, {ended('ing', 5, stem(3) + " || 'e'")}, {ended('ed', 4, stem(2))}, {ended('ed', 4, undoubled(stem(2)))}, {ended('ed', 4, stem(2) + " || 'e'")},
 {ended('er', 4, stem(2))}, {ended('est', 5, stem(3))}] else [] end as l from (select word, n, regexp_replace(seed, '^ +| +$', '', 'g') as s, {nocase(BARE)} as w from seeds))"""
CANDIDATES = rf"""{WORDS}, raw as (select word, {trim('word')} as r from words), cut as (select word, r, regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '^/+', ''), '^\\+', ''), '/+$', ''), '\\+$', '') as c from raw where r <> ''),
 keyed0 as (select word, r, c, trim(lower(translate(translate(regexp_replace(regexp_replace(c, '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'), {q(QUOTES + DASHES)}, {q("'" * len(QUOTES) + "-" * len(DASHES))}), 'Σ', 'σ'))) as k from cut),
 folded as (select *, {fold('k')} as f from keyed0), spaced as (select *, trim(regexp_replace(f, '[^\p{{L}}\p{{N}}'']+', ' ', 'g')) as p from folded),
 listed as (select word, [r, c, k, f, p, replace(p, ' ', '')] as l from spaced), seeds as (select word, min(n) as n, seed from (select word, unnest(l) as seed, generate_subscripts(l, 1) as n from listed) where seed <> '' group by word, seed),
 {LEMMAS}, ways as (select word, 0 as g, n, 0 as m, seed as candidate from seeds union all select word, 1, n, m, x from (select word, n, unnest(l) as x, generate_subscripts(l, 1) as m from lemmas) where x <> ''),
 once as (select word, candidate, min((g, n, m)) as o from ways group by word, candidate),
 candidates as (select word, (row_number() over (partition by word order by o) - 1)::int as pos, candidate from once qualify pos < 32)"""
LINK = r"""(?i)\b(src|href|xlink:href|data-src|data-href|poster)\s*=\s*["''][^"'']+["'']"""
EXTENSION = "(" + "|".join(RESOURCE_EXTENSIONS) + ")"
ASKED_FTS = "asked as (select distinct canonical as prefix from ref_headword union select distinct substring(canonical, 1, 4) from ref_headword)"


def match(asked: str) -> str:
    """fts(prefix, dict_id, id, text, score) of a table asked(prefix)."""
    terms = rf"regexp_extract_all({fold(low('prefix'))}, '[\p{{L}}\p{{N}}\p{{Co}}]+')"
    return f"""{asked}, listed as (select prefix, {terms} as ts from asked where not regexp_matches(prefix, '(^|[^\\p{{L}}\\p{{N}}])(AND|OR|NOT)($|[^\\p{{L}}\\p{{N}}])')), wantedt as (select prefix, len(ts) as terms, unnest(ts) as term from listed),
 docs as (select dict_id, id, text, {TOKENS} as ts from mdx_index where {FTS}), posts as (select dict_id, id, text, len(ts) as dl, unnest(ts) as token from docs), postings as (select dict_id, id, text, dl, token, count(*) as tf from posts group by all),
 st as (select dict_id, count(*) as n, avg(dl) as a from (select distinct dict_id, id, dl from postings) group by 1), terms as (select distinct term from wantedt),
 h as (select term, dict_id, id, text, dl, sum(tf) as tf from terms join postings on starts_with(token, term) group by all), f as (select *, count(*) over (partition by term, dict_id) as df from h),
 sc as (select term, dict_id, id, text, -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) as score from f join st using (dict_id)),
 fts as (select prefix, dict_id, id, text, sum(score) as score from wantedt join sc using (term) group by prefix, dict_id, id, text, terms having count(*) = terms)"""


def score(word: str, rank: str) -> str:
    return f"""(case when {low(word)} = {low('prefix')} then 1000 else 0 end + case when starts_with({low(word)}, {low('prefix')}) then 100 else 0 end
      + case when starts_with({word}, upper(substring(prefix, 1, 1))) then 20 else 0 end + 50 - least(strlen({word}), 50) + case when contains({word}, ' ') then 0 else 30 end
      - case when regexp_matches({word}, '\\p{{N}}') then 20 else 0 end - case when regexp_matches({word}, '[,;:]') then 10 else 0 end + {rank})::int"""


SQL: dict[str, str] = {
    "lemma_candidates": f"""with {WORDS}, seeds as (select word, 1 as n, word as seed from words), {LEMMAS}
     select word, array_to_string(list_filter(l, lambda x, i: x is not null and x <> '' and list_position(l, x) = i), '|') as lemmas from lemmas""",
    "query_candidates": f"with {CANDIDATES} select word, pos, candidate from candidates",
    "entry_lookup": f"""with {CANDIDATES}, {KEYED}, asked as (select word, 0 as step, 0 as pos, 2 as kind, {norm('word')} as key from words where {norm('word')} <> '' union all select word, 1, pos, 0, candidate from candidates
     union all select word, 1, pos, 1, {nocase('candidate')} from candidates union all select word, 1, pos, 2, candidate from candidates)
     select word, dict_id, step, pos, kind, id from asked join keyed using (kind, key) qualify row_number() over (partition by word, dict_id order by step, pos, kind, id) = 1""",
    "link_classify": rf"""with m as (select section_id, unnest(regexp_extract_all(body, '{LINK}', 0)) as m from aggregate_section), a as (select section_id, regexp_extract(m, '^([^\s=]+)', 1) as attr, regexp_extract(m, '(?s)["''](.*)["'']$', 1) as value from m),
     b as (select *, lower(attr) as la, {trim('value')} as v from a), c as (select *, regexp_extract(v, '(?s)^([^?#]*)', 1) as base, regexp_extract(v, '(?s)^[^?#]*(.*)$', 1) as suffix, regexp_extract(substring(v, 9), '(?s)^([^?#]*)', 1) as ebase from b),
     d as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace({trim('ebase')}, '^/+', ''), '/+$', ''), '^\\+', ''), '\\+$', '') as eword, regexp_replace(regexp_replace(regexp_replace(regexp_replace({trim('base')}, '^/+', ''), '/+$', ''), '^\\+', ''), '\\+$', '') as bword,
      array_to_string(list_filter(string_split(replace({trim('base')}, '\', '/'), '/'), lambda x: x not in ('', '.', '..')), '/') as path, regexp_replace(regexp_replace(base, '^/+', ''), '^\\+', '') as inside from c),
     e as (select *, regexp_matches(regexp_extract(base, '([^/]*)$', 1), '(?i)^.+\.{EXTENSION}$') as ext, inside <> '' and not regexp_matches(inside, '[/\\]') and not regexp_matches(inside, '(?i)^.+\.{EXTENSION}$') as single from d),
     f as (select *, case when regexp_matches(base, '^(\./|\.\./|\\|/)') or contains(base, '\') then not single else contains(base, '/') or ext end as looks from e)
     select section_id, attr, value, case when v = '' then 'none' when regexp_matches(v, '(?i)^(https?://|data:|javascript:|mailto:|tel:|about:|//|#)') then 'external' when starts_with(v, 'sound://') then 'audio'
      when starts_with(v, 'entry://') then case when eword <> '' then 'entry' else 'fragment' end when base = '' then case when suffix <> '' then 'fragment' else 'none' end
      when la in ('src', 'data-src', 'poster', 'xlink:href') or looks then case when path <> '' then 'resource' else 'none' end when bword <> '' then 'entry' when suffix <> '' then 'fragment' else 'none' end as kind, count(*) as n from f group by all""",
    "random_headword": f"select dict_id, id, text from mdx_index where {DISPLAY} order by md5(id || ':42'), id limit 10",
    "fts_trigrams": f"select dict_id, gram, count(*) as n from (select dict_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) as gram from (select dict_id, {low('text')} as t from mdx_index where {FTS})) group by all",
    "fts_match": f"with {match(ASKED_FTS)} select prefix, dict_id, id, text, round(score, 6)::double as score from fts",
    "fts_trigram_match": f"with asked as (select distinct substring(canonical, 3, 4) as term from ref_headword) select term, dict_id, id from asked join mdx_index on contains({low('text')}, {low('term')}) where {FTS}",
    "suggest_fts": f"""with {match(ASKED_FTS.replace("asked as", "asked0 as") + ", asked as (select distinct trim(prefix) as prefix from asked0 where strlen(trim(prefix)) >= 2)")},
     top as (select * from fts qualify row_number() over (partition by prefix, dict_id order by score, id) <= 200), kept as (select prefix, dict_id, text as word, {score('text', 'round(-score * 1000)')} as score from top where {SUGGEST}),
     lows as (select prefix, {norm('prefix')} as lo from asked where {norm('prefix')} <> ''), ranked as (select w.prefix, i.dict_id, i.id, i.text, row_number() over (partition by w.prefix, i.dict_id order by length(text), text, id) as r from lows w join mdx_index i on starts_with(i.normalized, w.lo) where length(i.text) < 50 qualify r <= 200),
     rest as (select prefix, dict_id, text as word, {score('text', '-(r - 1) * 1000')} as score from ranked where {SUGGEST} and not exists (select 1 from kept k where k.prefix = ranked.prefix and k.dict_id = ranked.dict_id)),
     m as (select prefix, word, max(score) as score from (select prefix, word, score from kept union all select prefix, word, score from rest) group by all)
     select prefix, word, score, row_number() over (partition by prefix order by case when {low('word')} = {low('prefix')} then 0 else 1 end,
      case when {low('word')} = {low('prefix')} then 0 when {norm('word')} = {norm('prefix')} then 0 else 1 end, case when {low('word')} = {low('prefix')} then 0 else -score end,
      strlen(word), {low('word')}, word)::int as place from m qualify place <= 10""",
    "p6_keys": """with r as (select 'aggregate_section' as "table", strftime(fetched_at, '%Y-%m') as period, index_id as k from aggregate_section union all select 'query_json_payload', strftime(created_at, '%Y-%m'), query_id from query_json_payload
     union all select 'fuzzy_suggestion', null, query_id from fuzzy_suggestion), j as (select *, case when "table" = 'aggregate_section' then k not in (select id from mdx_index where id is not null) else k not in (select query_id from query_form where query_id is not null) end as bad from r where k is not null)
     select period, "table", count(*) as "references", count(*) filter (bad) as orphans, count(distinct k) filter (bad) as orphan_keys from j group by period, "table" """,
    "normalize_headwords": f"select id, {norm('text')} as norm from mdx_index",
    "fold_diacritics": f"select id, {fold('text')} as folded from mdx_index",
    "lookup_keys": rf"""with {WORDS}, a as (select word, regexp_replace(word, '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g') as c from words),
     b as (select word, regexp_replace(c, '[\s\p{{Z}}]+', ' ', 'g') as c from a)
     select word, trim(lower(translate(translate(c, {q(QUOTES + DASHES)}, {q("'" * len(QUOTES) + "-" * len(DASHES))}), 'Σ', 'σ'))) as key from b""",
    "word_predicates": f"select id, {RESOURCE} as resource, {SUGGEST} as suggest, {FTS} as fts, {FUZZY} as fuzzy, {DISPLAY} as display from mdx_index",
    "strip_tags": r"select section_id, trim(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'gs'), '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g')) as plain from aggregate_section",
    "sanitize": r"""select section_id, regexp_replace(body, '(?i)\s+on\w+\s*=\s*["''][^"'']*["'']|(src|href)\s*=\s*["'']\s*javascript:[^"'']*["'']', '', 'g') as safe from aggregate_section""",
    "escape_html": """select section_id, replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped from aggregate_section""",
    "percent_encode": "select id, replace(replace(replace(replace(url_encode(text), '-', '%2D'), '_', '%5F'), '.', '%2E'), '~', '%7E') as encoded from mdx_index",
    "link_target": f"select section_id, {TARGET} as target from aggregate_section where {TARGET} <> ''",
    "resource_paths": rf"select id, array_to_string(list_filter(string_split(replace(text, '\', '/'), '/'), lambda x: x not in ('', '.', '..')), '/') as path, {MIME} as mime from mdx_index where {RESOURCE}",
    "lookup_exact": f"with {WORDS} select word, dict_id, min(id) as id from words join mdx_index on word = text group by all",
    "lookup_nocase": f"with {WORDS} select word, dict_id, min(id) as id from words join mdx_index on {nocase('word')} = {nocase('text')} group by all",
    "lookup_normalized": f"with {WORDS}, w as (select word, {norm('word')} as k from words) select word, dict_id, min(id) as id from w join mdx_index on k = normalized where k <> '' group by all",
    "lookup_cascade": f"with {CASCADE} select * from cascade",
    "cross_dict_first_hit": f"""with {CASCADE}, cat as (select dict_id, row_number() over (order by path) as ord from dict_header)
     select word, dict_id, ord, kind, id from cascade join cat using (dict_id) qualify row_number() over (partition by word order by ord) = 1""",
    "filtered_lookup": f"""with q as (select distinct query_id, word, {FILTER} as only_ from query_form where word is not null),
     hit as (select word, dict_id, min(id) as id from (select distinct word from q) join mdx_index on word = text group by all)
     select query_id, dict_id, id from q join hit using (word) where len(only_) = 0 or list_contains(only_, dict_id)""",
    "resource_lookup": rf"""with asked as (select distinct regexp_replace(text, '^[\\/]+', '') as word from mdx_index where {RESOURCE}),
     c as (select word, replace(word, '\', '/') as s, replace(word, '/', '\') as b from asked),
     cands as (select word, 0 as pos, s as k from c union all select word, 1, '/' || s from c union all select word, 2, b from c where b <> s union all select word, case when b = s then 2 else 3 end, '\' || b from c)
     select word, dict_id, pos::int as pos, id from cands join mdx_index on k = text qualify row_number() over (partition by word, dict_id order by pos, id) = 1""",
    "redirect_chase": f"""with recursive {LINKS}, walk as (select distinct child as node, child as last, 0 as hops from links union all select node, parent, hops + 1 from walk join links on last = child where hops <= 5)
     select node, last, hops::int as hops, case when hops > 5 then 'too_many_redirects' else 'ok' end as status from walk qualify row_number() over (partition by node order by hops desc) = 1""",
    "redirect_trace": f"""with recursive {LINKS}, walk as (select distinct child as node, child as last, child::varchar as chain, 0 as depth from links
     union all select node, parent, chain || '>' || parent, depth + 1 from walk join links on last = child where depth < 10)
     select node, chain, depth::int as depth from walk qualify row_number() over (partition by node order by depth desc) = 1""",
    "suggest_prefix": f"""with {HITS}, d as (select distinct prefix, dict_id, text from hits)
     select prefix, dict_id, row_number() over (partition by prefix, dict_id order by length(text), text)::int as rank, text from d qualify rank <= 10""",
    "suggest_merged": f"""with {HITS}, ranked as (select *, row_number() over (partition by prefix, dict_id order by length(text), text, id) as r from hits where strlen(trim(prefix)) >= 2 qualify r <= 200),
     scored as (select prefix, text as word, (case when {low('text')} = {low('prefix')} then 1000 else 0 end + case when starts_with({low('text')}, {low('prefix')}) then 100 else 0 end
      + case when starts_with(text, upper(substring(prefix, 1, 1))) then 20 else 0 end + 50 - least(strlen(text), 50) + case when contains(text, ' ') then 0 else 30 end
      - case when regexp_matches(text, '\\p{{N}}') then 20 else 0 end - case when regexp_matches(text, '[,;:]') then 10 else 0 end - (r - 1) * 1000)::int as score from ranked where {SUGGEST}),
     m as (select prefix, word, max(score) as score from scored group by all)
     select prefix, word, score, row_number() over (partition by prefix order by case when {low('word')} = {low('prefix')} then 0 else 1 end,
      case when {low('word')} = {low('prefix')} then 0 when {norm('word')} = {norm('prefix')} then 0 else 1 end, case when {low('word')} = {low('prefix')} then 0 else -score end,
      strlen(word), {low('word')}, word)::int as place from m qualify place <= 10""",
    "fts_postings": f"with {POSTINGS} select dict_id, id, dl::int as dl, token, tf from postings",
    "fts_bm25": f"""with {PREFIXES}, {POSTINGS}, terms as (select distinct lo as term from wanted), st as (select dict_id, count(*) as n, avg(dl) as a from (select distinct dict_id, id, dl from postings) group by 1),
     h as (select term, dict_id, id, dl, sum(tf) as tf from terms join postings on starts_with(token, {low('term')}) group by all), f as (select *, count(*) over (partition by term, dict_id) as df from h)
     select term, dict_id, id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)), 6)::double as score from f join st using (dict_id)""",
    "hit_counts": "select matched as word, count(distinct section_id) as hit_count, count(distinct dict_id) as dictionaries from aggregate_section where matched is not null group by 1",
    "dict_list": r"""select dict_id, arg_min(coalesce(title, regexp_extract(path, '([^/\\]+)\.[^./\\]*$', 1)), (kind <> 'mdx')::int || path) as name, min(path) filter (kind = 'mdx') as primary_path,
     count(*) filter (kind = 'mdx') as texts, count(*) filter (kind = 'mdd') as resources from dict_header group by 1""",
    "index_stats": f"select dict_id, count(*) as rows, count(normalized) as normalized, max(id) as max_id, count(*) filter ({FTS}) as fts from mdx_index group by 1",
    "index_status": """with m as (select path, case when lang = 'en' then 3 else 4 end as v, header_id as size, source_mtime + case when lang = 'fr' then 1 else 0 end as mtime from dict_header where kind = 'mdx')
     select h.path, m.path is not null as exists, coalesce(v = 4 and m.size = h.header_id and m.mtime = h.source_mtime, false) as up_to_date from dict_header h left join m using (path)""",
    "change_set": """with o as (select path, header_id as size, source_mtime as mtime from dict_header where lang <> 'de'), n as (select path, header_id as size, source_mtime + case when lang = 'pl' then 5 else 0 end as mtime from dict_header where lang <> 'ru')
     select coalesce(o.path, n.path) as path, case when n.path is null then 'removed' when o.path is null then 'added' else 'changed' end as change from o full join n on o.path = n.path
     where o.path is null or n.path is null or o.size is distinct from n.size or o.mtime is distinct from n.mtime""",
    "favorites_upsert": f"select {trim('word')} as word, max(epoch_us(ts)) as added_at from query_form where word is not null and {trim('word')} <> '' group by 1",
    "favorites_list": f"""with f as (select {trim('word')} as word, max(epoch_us(ts)) as added_at from query_form where word is not null and {trim('word')} <> '' group by 1)
     select row_number() over (order by added_at desc, word)::int as rank, word, added_at from f qualify rank <= 100""",
    "history_top20": f"""with v as (select session_id as user, {trim('word')} as word, epoch_us(ts) as ts from query_form where word is not null and session_id is not null and length({trim('word')}) >= 2),
     l as (select * from v qualify row_number() over (partition by user, {low('word')} order by ts desc, word desc) = 1)
     select user, row_number() over (partition by user order by ts desc, word)::int as place, word, ts from l qualify place <= 20""",
    "debounce_sessions": """with e as (select user_id, epoch_us(ts) as t from events where event_type <> 'error'), g as (select *, case when t - lag(t) over (partition by user_id order by t) <= 300000000 then 0 else 1 end as b from e),
     s as (select *, sum(b) over (partition by user_id order by t rows unbounded preceding) as s from g)
     select user_id, min(t) as start, max(t) + 300000000 as stop, count(*) as n from s group by user_id, s""",
    "cache_keys": f"""with k as (select 'entry:aggregate:' || {low(trim('word'))} || case when format = 'json' then ':json' else '' end as a, array_to_string(list_sort({FILTER}), ',') as ids from query_form where word is not null)
     select case when ids = '' then a else a || ':' || ids end as key, count(*) as n from k group by 1""",
    "cache_admission": f"""with r as (select id, {MIME} as mime, record_length * 512 as size from mdx_index where {RESOURCE})
     select id, mime, size, case when regexp_matches(mime, '^(audio|video|image)/') then size <= 262144 else size <= 1048576 end as cache from r""",
    "block_prefix_sum": """with b as (select dict_id, block_offset, max(block_dsize) as dsize from mdx_index group by all)
     select dict_id, block_offset, dsize, coalesce(sum(dsize) over (partition by dict_id order by block_offset rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from b""",
    "record_locations": """select id, record_offset // 16384 as block_no, record_offset % 16384 as start, least(record_offset % 16384 + record_length, 16384) as stop from mdx_index""",
    "inflected_matches": f"select payload_id, lower({trim('word')}) <> lower({trim('matched')}) as inflected from query_json_payload where word is not null and matched is not null",
    # a record that crosses the end of its block is clamped to it
    "container_scan": f"""with r as (select ref_id as id, canonical as text, strlen(canonical) + 7 as n from ref_headword), o as (select *, sum(n) over (order by id) - n as off from r),
     t as (select *, sum(n) over () as total from o), l as (select id, text, {norm('text')} as normalized, least(n, 1000 - off % 1000)::bigint as record_length from t)
     select f as file, id, text, normalized, record_length, record_length::int as bytes from l, (values ('v1'), ('v2')) v(f)""",
}
