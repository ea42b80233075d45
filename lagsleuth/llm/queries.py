"""One registered query per operator: production parameters, whole tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, line_dups, merkle, mixing, near_dups, pieces, sharding, substrings, token_files, toxicity, winnowing
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
SHARDS = 40
SQL: dict[str, str] = {}


def op4_substrings(spark, d):
    return substrings.remove_repeats(table(spark, d, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op4_substrings"] = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 11)) i from words)),
gone as (select distinct doc_id, unnest(range(i, i + 13)) p from (select doc_id, i, min(doc_id) over (partition by k) least from windows) where least < doc_id),
each as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from words),
kept as (select doc_id, count(*) n, string_agg(x, ' ' order by p) t from each anti join gone using (doc_id, p) group by 1)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from words left join kept using (doc_id)"""


def op5_sharding(spark, d):
    return sharding.shard_by_bytes(table(spark, d, "documents"), SHARDS)


def op6_byte_bpe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_near_dups(spark, d):
    return near_dups.components(table(spark, d, "documents"), size=2)


SQL["op7_near_dups"] = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as (select distinct doc_id, s from (select doc_id, w[i] || ' ' || w[i + 1] s from (select doc_id, w, unnest(range(1, len(w))) i from words)
         union all select doc_id, w[1] from words where len(w) = 1)),
sizes as (select doc_id, count(*) n from sets group by 1),
shared as (select a.doc_id x, b.doc_id y, count(*) m from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * m >= 80 * (a.n + b.n - m)),
ways as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (select doc_id, doc_id from words union select doc_id, y from reach join ways on other = x),
least as (select doc_id, min(other) component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, component_id = doc_id kept from least left join sizes using (doc_id)"""


def op8_line_dups(spark, d):
    cleaned = line_dups.remove_similar_lines(table(spark, d, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op8_line_dups"] = r"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) k from documents),
words as (select doc_id, k, t, list_sort(list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) s from lines),
sets as (select s, len(s) n, min((doc_id, k)) pos, row_number() over () id from words where len(s) > 0 group by s),
tokens as (select id, n, unnest(s) x from sets),
shared as (select a.id i, b.id j, any_value(a.n) n, any_value(b.n) o, count(*) m from tokens a join tokens b on a.x = b.x and a.id <> b.id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by 1, 2),
near as (select i id, min(pos) near_pos from shared join sets on j = id where 100 * m >= 80 * (shared.n + o - m) group by 1),
marked as (select doc_id, k, t, len(words.s) > 0 has, coalesce(least(pos, coalesce(near_pos, pos)) < (doc_id, k), false) gone
           from words left join sets on words.s = sets.s left join near using (id))
select doc_id, count(*) filter (has)::bigint n_lines, count(*) filter (gone)::bigint n_removed, sha256(coalesce(string_agg(t, chr(10) order by k) filter (not gone), '')) kept_sha256
from marked group by 1"""


CATEGORIES = ["low_quality", "toxic"]


def toxicity_chain(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.fit(table(spark, d, "documents"), labels, CATEGORIES)


def op9_toxicity(spark, d):
    chain = toxicity_chain(spark, d)
    scored = toxicity.predict(table(spark, d, "documents").select("doc_id", "text"), chain)
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= chain.thresholds[-1]).alias("toxic"))


def op10_decontamination(spark, d):
    found = decontaminate.find(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    items = F.array_sort(F.array_distinct("matches.item_id"))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


SQL["op10_decontamination"] = r"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
items as (select coalesce(item_id::varchar, '') item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
cut as (select item_id, w, least(len(w), 10) m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from items where len(w) > 0),
keys as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') k from cut),
sizes as (select distinct m from keys),
places as (select doc_id, m, w, unnest(range(1, len(w) - m + 2)) i from words, sizes where len(w) >= m),
hits as (select doc_id, m, i, item_id from (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') k from places) join keys using (m, k)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + m)) p from hits) group by 1),
own as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) s from hits group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256,
       coalesce(n_hit, 0) > 0 contaminated
from words left join hit using (doc_id) left join own using (doc_id)"""


def op1_token_files(spark, d):
    path = token_files.new_path(spark)
    token_files.write(table(spark, d, "documents"), path, public_tokenizers.path(WORD_TOKENIZER), end_id=1, cut_at_space=True)
    return token_files.with_crc32(token_files.read(spark, path))


def op2_context_mixing(spark, d):
    return mixing.score(table(spark, d, "documents"))


def op3_winnowing(spark, d):
    return winnowing.compare_with_next(table(spark, d, "documents").select("doc_id", "text"))


def op11_sentencepiece(spark, d):
    coded = pieces.round_trip(table(spark, d, "documents").select("doc_id", "text"), public_tokenizers.path(PIECES))
    return coded.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark, d):
    docs = table(spark, d, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.text_digest(MANIFEST_COLUMNS, {"text": F.translate("text", UPPER, LOWER)}))
    made = merkle.verified(merkle.manifest(docs, MANIFEST_COLUMNS, "source", "doc_id", tampered))
    return made.select(F.col("own_key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "log_position")


SQL["op12_merkle_manifest"] = r"""
with recursive fields as (select *, doc_id::varchar a, n_chars::varchar b, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
       lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, k: xor(y >> 1, 3988292384::bigint * (y & 1)))) crc from documents),
digests as (select doc_id, source, crc, coalesce(strlen(a) || ':' || a, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(b) || ':' || b, '-') h, text from fields),
leaves as (select doc_id, source, sha256(h || coalesce(strlen(text) || ':' || text, '-')) leaf,
       case when xor(crc, 4294967295::bigint) % 5 = 0 then sha256(h || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end changed from digests),
sources as (select source, row_number() over (order by source nulls first) - 1 tree from leaves group by source),
base as (select tree, doc_id, leaf, coalesce(changed, leaf) now, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 i from leaves join sources on leaves.source is not distinct from sources.source),
grow as (select tree, 0 l, i, leaf h from base union all
       select tree, l + 1, i // 16, sha256(string_agg(h, '' order by i)) from (select *, count(*) over (partition by tree) n from grow) where n > 1 group by tree, l, i // 16),
depth as (select tree, max(l) d from grow group by tree),
subroots as (select tree, h, d from grow join depth using (tree) where l = d),
over_all as (select 0 l, tree i, h from subroots union all
       select l + 1, i // 16, sha256(string_agg(h, '' order by i)) from (select *, count(*) over () n from over_all) where n > 1 group by l, i // 16),
runs as (select tree, l, i // 16 run, list(h order by i) hs from grow group by all),
top_runs as (select l, i // 16 run, list(h order by i) hs from over_all group by all),
climb as (select tree, doc_id, leaf, i, 0 l, now h, '' proof from base union all
       select c.tree, doc_id, leaf, c.i // 16, c.l + 1, sha256(array_to_string(hs[:c.i % 16] || [c.h] || hs[c.i % 16 + 2:], '')), proof || array_to_string(hs[:c.i % 16] || hs[c.i % 16 + 2:], '')
       from climb c join depth using (tree) join runs r on r.tree = c.tree and r.l = c.l and r.run = c.i // 16 where c.l < d),
up as (select c.tree, doc_id, leaf, s.h subroot, c.tree i, 0 l, c.h, proof from climb c join subroots s on s.tree = c.tree and c.l = s.d union all
       select u.tree, doc_id, leaf, subroot, u.i // 16, u.l + 1, sha256(array_to_string(hs[:u.i % 16] || [u.h] || hs[u.i % 16 + 2:], '')), proof || array_to_string(hs[:u.i % 16] || hs[u.i % 16 + 2:], '')
       from up u join top_runs r on r.l = u.l and r.run = u.i // 16 where u.l < (select max(l) from over_all)),
ends as (select doc_id, leaf, subroot, (select h from over_all order by l desc limit 1) root, sha256(proof) proof_sha256, up.h folded_root, tree from up where up.l = (select max(l) from over_all)),
places as (select tree, leaf, doc_id, i + i // 16 + i // 256 + i // 4096 + i // 65536 + i // 1048576 + i // 16777216 log_position from base)
select ends.doc_id, ends.leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified, log_position::bigint log_position
from ends join places on ends.tree = places.tree and ends.leaf = places.leaf and ends.doc_id is not distinct from places.doc_id"""


def op13_source_divergence(spark, d):
    return divergence.audit(table(spark, d, "documents"))


SQL["op13_source_divergence"] = r"""
with docs as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
terms as (select id, lang, source, unnest(w) term from docs),
kept as (select lang, term, count(*) in_lang from terms group by 1, 2 having count(distinct id) >= 30),
langs as (select lang, sum(in_lang) n, count(*) v from kept group by 1),
cells as (select lang, source, term, count(*) c from terms join kept using (lang, term) group by 1, 2, 3),
totals as (select lang, source, sum(c) n from cells group by 1, 2),
occurring as (select distinct lang, source from docs),
shares as (select o.lang, o.source, k.term, coalesce(c, 0) c, 1 + 1000000000::hugeint * (coalesce(c, 0) + 5) // (coalesce(t.n, 0) + 5 * v) p,
       1 + 1000000000::hugeint * (in_lang + 5) // (langs.n + 5 * v) q
       from occurring o join kept k on k.lang = o.lang join langs on langs.lang = o.lang left join totals t on t.lang = o.lang and t.source = o.source
       left join cells on cells.lang = o.lang and cells.source = o.source and cells.term = k.term),
apart as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint as value from occurring a join occurring b on a.lang = b.lang and a.source <> b.source
       left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source),
over as (select lang, source, 'term' part, term item, (p - q)::bigint as value from shares where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pairs union all select * from over))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 50"""


QUERIES = {f.__name__: f for f in (op1_token_files, op2_context_mixing, op3_winnowing, op4_substrings, op5_sharding, op6_byte_bpe, op7_near_dups, op8_line_dups, op9_toxicity, op10_decontamination,
                                  op11_sentencepiece, op12_merkle_manifest,
                                  op13_source_divergence)}
