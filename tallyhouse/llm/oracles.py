"""What SQL says to the queries of this folder, where it can tell."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_ESCAPE = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')"

_TERMS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_ORACLES = {
    "op1_substring_dedup": f"""
with docs as (select doc_id, {_WORDS.format("coalesce(text, '')")} as words from documents),
windows as (select doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) as w
            from (select doc_id, words, unnest(range(1, len(words) - 48)) as s from docs)),
firsts as (select w, min(doc_id) as first_id from windows group by w),
gone as (select distinct doc_id, unnest(range(s, s + 50)) as i
         from windows join firsts using (w) where first_id < doc_id),
words as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from docs),
kept as (select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n
         from words anti join gone using (doc_id, i) group by doc_id)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from docs left join kept using (doc_id)""",
    "op2_ngram_jaccard": f"""
with recursive docs as (select doc_id, {_WORDS.format(_LOWER)} as words from documents),
grams as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [md5(array_to_string(words, ' '))]
              else list_transform(range(1, len(words) - 3), lambda s: md5(array_to_string(words[s:s + 4], ' '))) end) as g from docs),
sizes as (select doc_id, count(*) as n, md5(string_agg(g, '' order by g)) as class from grams group by doc_id),
classes as (select class, min(doc_id) as class_id, any_value(n) as n from sizes group by class),
shared as (select g from grams semi join (select class_id as doc_id from classes) using (doc_id) group by g having count(*) > 1),
met as (select a.doc_id as a, b.doc_id as b, count(*) as c
        from (select * from grams semi join shared using (g)) a join (select * from grams semi join shared using (g)) b using (g)
        where a.doc_id < b.doc_id and a.doc_id in (select class_id from classes) and b.doc_id in (select class_id from classes) group by all),
links as (select a, b from met join classes x on x.class_id = a join classes y on y.class_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select class_id, class_id from classes union select r.a, l.b from reach r join edges l on l.a = r.b),
roots as (select a as class_id, min(b) as root from reach group by a)
select doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(root, doc_id)::bigint as component_id, coalesce(class_id, doc_id)::bigint as class_id
from documents left join sizes s using (doc_id) left join classes using (class) left join roots using (class_id)""",
    "op10_chat_format": f"""
with turns as (select conv_id::bigint as conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
texts as (select conv_id, count(*)::bigint as n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as whole,
                 coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
                 sum(20 + length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}))::bigint as formatted_chars
          from turns group by conv_id)
select conv_id, n_turns, sha256(whole) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from texts""",
    "op12_block_search": f"""
with docs as (select doc_id, {_TERMS.format(_LOWER)} as terms from documents),
whole as (select count(*) filter (where len(terms) > 0) as n_docs, sum(len(terms))::bigint as n_terms from docs),
sizes as (select doc_id, 100 - 90 + (90 * len(terms)::bigint * n_docs) // n_terms as m from docs, whole where len(terms) > 0),
postings as (select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(terms) as term from docs) group by all),
weights as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w
            from (select term, count(*) as df from postings group by term), whole),
items as (select distinct item_id, unnest({_TERMS.format(_LOWER)}) as term from benchmark),
scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
           from items join postings using (term) join weights using (term) join sizes using (doc_id) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
