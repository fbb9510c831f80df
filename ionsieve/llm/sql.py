"""Queries of this folder that SQL can express whole, for DuckDB: plain forms over the same tables."""

RULE_CASCADE = r"""
with texts as (select doc_id, row_number() over () as r, coalesce(text, '') as text from documents),
parts as (
    select r, doc_id, text,
           regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from texts),
windows as (
    select r, unnest(range(0, len(words) - 4)) as i,
           unnest(list_transform(range(1, len(words) - 3), lambda i: words[i : i + 4])) as w
    from parts where len(words) >= 5),
repeats as (select r, i from windows qualify count(*) over (partition by r, w) > 1),
covered as (select r, count(distinct i + k) as n from repeats, range(0, 5) as s(k) group by r),
counts as (
    select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
           len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
           len(lines) as n_lines, length(regexp_replace(text, '\P{L}', '', 'g')) as n_letters,
           length(regexp_replace(text, '\P{Lu}', '', 'g')) as n_capitals,
           len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) as n_lettered
    from parts left join covered c using (r)),
failed as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 100 * n_symbols > 30 * n_words
            or 100 * (n_dup_lines - 2) > 30 * n_lines or 100 * n_capitals > 40 * n_letters
            or 100 * n_lettered < 50 * n_words) as kept
from failed"""


RANKED_SEARCH = r"""
with lowered as (select doc_id, row_number() over () as r,
                        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
wanted as (select item_id, row_number() over () as q,
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from benchmark),
occurrences as (select r, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from lowered),
asked as (select distinct q, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from wanted),
postings as (select r, term, count(*) as tf from occurrences group by r, term),
sizes as (select r, count(*) as n from occurrences group by r),
totals as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from sizes),
holders as (select term, count(*) as df from postings group by term),
weights as (
    select q, term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / (2 * df + 1))) as bigint) as w
    from asked join holders using (term) cross join totals),
scores as (
    select q, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) as bigint) as score
    from weights join postings using (term) join sizes using (r) cross join totals group by q, r),
placed as (
    select item_id, doc_id, score,
           cast(row_number() over (partition by q order by score desc, doc_id nulls first) as int) as rank
    from scores join wanted using (q) join lowered using (r) where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 50"""
