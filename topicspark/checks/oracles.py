"""The same results in SQL, from the given tables alone."""

from __future__ import annotations

from topicspark.checks.catalog import ALPHA, ALPHA_AS, BETA, SEED, SIMILAR, TOPICS

ORACLES: dict[str, str] = {}

_UNIFORM = "('0x' || substr(md5(concat_ws('|', {}, doc_id, term_id, occ)), 1, 13))::BIGINT"
_LINES = r"SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS value FROM documents"

# Common tables, each with those it needs. e: tokens with their uniform topic; dt, tt, nk: counters.
_CTE = {
    "w": ((), r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents"),
    "vocab": (("w",), """SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term
        FROM (SELECT term FROM w GROUP BY term)"""),
    "bow": (("vocab",), "SELECT doc_id, term_id, count(*) AS cnt FROM w JOIN vocab USING (term) GROUP BY doc_id, term_id"),
    "lines": (("bow",), """SELECT doc_id::VARCHAR || ' ' || string_agg(term_id || ':' || cnt, ' ' ORDER BY term_id) AS value
        FROM bow GROUP BY doc_id"""),
    "occ": (("bow",), "SELECT doc_id, term_id, unnest(range(cnt)) AS occ FROM bow"),
    "e": (("occ",), f"SELECT doc_id, term_id, occ, CAST({_UNIFORM.format(f'{SEED}, 0')} % {TOPICS} AS INTEGER) AS topic FROM occ"),
    "e2": (("occ",), f"SELECT doc_id, term_id, occ, CAST({_UNIFORM.format(f'{SEED + 1}, 0')} % {TOPICS} AS INTEGER) AS topic FROM occ"),
    "dt": (("e",), "SELECT doc_id, topic, count(*) AS cnt FROM e GROUP BY doc_id, topic"),
    "tt": (("e",), "SELECT term_id, topic, count(*) AS cnt FROM e GROUP BY term_id, topic"),
    "tt2": (("e2",), "SELECT term_id, topic, count(*) AS cnt FROM e2 GROUP BY term_id, topic"),
    "ks": ((), f"SELECT CAST(range AS INTEGER) AS topic FROM range({TOPICS})"),
    "nk": (("tt", "ks"), """SELECT topic, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS cnt
        FROM ks LEFT JOIN tt USING (topic) GROUP BY topic"""),
    "size": (("vocab", "e"), "SELECT (SELECT count(*) FROM vocab) AS v, (SELECT count(*) FROM e) AS n"),
    # the mean of two uniform starts
    "mt": (("tt", "tt2"), """SELECT term_id, topic, sum(cnt) / 2.0::DOUBLE AS cnt
        FROM (SELECT * FROM tt UNION ALL SELECT * FROM tt2) GROUP BY term_id, topic"""),
    "mk": (("mt", "ks"), "SELECT topic, coalesce(sum(cnt), 0)::DOUBLE AS cnt FROM ks LEFT JOIN mt USING (topic) GROUP BY topic"),
    "vocab2": (("vocab",), """SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS new_id, term_id
        FROM vocab WHERE length(term) > 3"""),
    "gram": (("tt",), """SELECT a.topic AS topic_a, b.topic AS topic_b, sum(a.cnt * b.cnt)::DOUBLE AS dot
        FROM tt a JOIN tt b ON a.term_id = b.term_id AND a.topic <= b.topic GROUP BY a.topic, b.topic"""),
    "sim": (("gram",), """SELECT g.topic_a, g.topic_b, g.dot / (sqrt(x.dot) * sqrt(y.dot)) AS sim FROM gram g
        JOIN gram x ON x.topic_a = g.topic_a AND x.topic_b = g.topic_a
        JOIN gram y ON y.topic_a = g.topic_b AND y.topic_b = g.topic_b WHERE g.topic_a < g.topic_b"""),
    "near": (("sim",), f"SELECT topic_b AS topic, min(topic_a) AS target FROM sim WHERE sim > {SIMILAR} GROUP BY topic_b"),
    "held": (("e", "dt", "tt", "nk", "size"), """SELECT doc_id, term_id, topic, dt.cnt AS n_dk, tt.cnt AS n_kw, nk.cnt AS n_k, v, n
        FROM (SELECT DISTINCT doc_id, term_id, topic FROM e) JOIN dt USING (doc_id, topic)
        JOIN tt USING (term_id, topic) JOIN nk USING (topic), size"""),
    # perplexity: p without its last factor, per document and term
    "fk": (("nk", "size"), f"SELECT topic, nk.cnt + v * {BETA} AS denom FROM nk, size"),
    "docs": (("dt", "fk"), f"SELECT doc_id, sum(cnt) AS n_d, sum(cnt * {BETA} / denom) AS part FROM dt JOIN fk USING (topic) GROUP BY doc_id"),
    "terms": (("tt", "fk"), f"SELECT term_id, sum(cnt * {ALPHA} / denom) AS part FROM tt JOIN fk USING (topic) GROUP BY term_id"),
    "pairs": (("bow", "dt", "tt", "fk"), """SELECT doc_id, term_id, sum(dt.cnt * tt.cnt / denom) AS shared
        FROM bow JOIN dt USING (doc_id) JOIN tt USING (term_id, topic) JOIN fk USING (topic) GROUP BY doc_id, term_id"""),
    "p": (("pairs", "docs", "terms", "size"), f"""SELECT bow.cnt, n, n_d,
            coalesce(shared, 0) + docs.part + terms.part + (SELECT sum({ALPHA} * {BETA} / denom) FROM fk) AS p
        FROM bow JOIN docs USING (doc_id) JOIN terms USING (term_id) LEFT JOIN pairs USING (doc_id, term_id), size"""),
    "perp": (("p",), f"""SELECT exp(-sum(cnt * ln(p / (n_d + {TOPICS} * {ALPHA}))) / max(n)) AS perplexity,
        exp(-sum(cnt * ln(p * (1 + 1 / (n_d + {TOPICS} * {ALPHA})))) / max(n)) AS compat FROM p"""),
}


def _with(names: str, select: str) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for needed in _CTE[name][0]:
                add(needed)
            done.append(name)

    for name in names.split():
        add(name)
    tables = ",\n".join(f"{name} AS MATERIALIZED ({_CTE[name][1]})" for name in done)
    return f"WITH {tables}\n{select}"


def oracle(name: str, tables: str, select: str) -> None:
    ORACLES[name] = _with(tables, select) if tables else select


def _decimals(x: str, places: int) -> str:
    """x with so many decimals, its decimal text rounded half up."""
    return f"CAST(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)) AS DECIMAL(38, {places})) AS VARCHAR)"


_BOW = "SELECT doc_id, term_id, cnt FROM bow"


def _prior(n_k: str, own: int = 0) -> str:
    return f"(({n_k} - {own} + {ALPHA_AS}) * {ALPHA} * {TOPICS} / (n - 1 + {ALPHA_AS} * {TOPICS}))"


def _word(n_kw: str, n_k: str, own: int = 0) -> str:
    return f"(({n_kw} - {own} + {BETA}) / ({n_k} - {own} + v * {BETA}))"


def _doc(n_dk: str, n_k: str, own: int = 0) -> str:
    return f"({n_dk} - {own} + {_prior(n_k, own)})"


# sources
oracle("read_lines", "", _LINES)
oracle("read_num_terms", "vocab", "SELECT count(*) AS num_terms FROM vocab")
oracle("read_vocab", "vocab", "SELECT term_id, term FROM vocab")
oracle("parse_bow", "bow", "SELECT doc_id, term_id, 2 * cnt AS cnt FROM bow")
oracle("read_corpus", "bow", _BOW)
oracle("restore_params", "perp", f"""SELECT {ALPHA}::DOUBLE AS alpha, {BETA}::DOUBLE AS beta, {ALPHA_AS}::DOUBLE AS alpha_as,
    round(perplexity, 2) AS perplexity FROM perp""")
oracle("restore_topic_totals", "mk", f"SELECT topic, cnt FROM mk UNION ALL SELECT {TOPICS}, 0.0")
oracle("restore_term_topic", "mt vocab2", "SELECT new_id AS term_id, topic, cnt FROM mt JOIN vocab2 USING (term_id)")
oracle("load_model", "mt mk vocab2", f"""SELECT new_id AS term_id, topic, mt.cnt, mk.cnt AS total, {ALPHA_AS}::DOUBLE AS alpha_as
    FROM mt JOIN vocab2 USING (term_id) JOIN mk USING (topic)""")
oracle("load_text_model", "mt mk", f"""SELECT term_id, topic, mt.cnt, mk.cnt AS total, {ALPHA_AS}::DOUBLE AS alpha_as
    FROM mt JOIN mk USING (topic)""")

# sinks
oracle("write_single_text", "lines", "SELECT value, 1::BIGINT AS files FROM lines")
_FIELDS = f"""SELECT CASE WHEN len(f) >= 3 THEN f[1] END AS c0, CASE WHEN len(f) >= 3 THEN f[2] END AS c1,
    CASE WHEN len(f) >= 3 THEN f[3] END AS c2
    FROM (SELECT string_split(regexp_replace(value, ',+$', ''), ',') AS f FROM ({_LINES}))"""
oracle("write_rows", "", _FIELDS)
oracle("topic_totals_report", "mk", f"""SELECT row_number() OVER (ORDER BY cnt DESC, topic) - 1 AS rank,
    topic || ' ' || {_decimals('cnt', 2)} AS value FROM mk""")
for _name, _value, _places in (("topic_terms_report", "mt.cnt", 2), ("topic_term_probs_report", "mt.cnt / mk.cnt", 8)):
    oracle(_name, "mt mk vocab", f"""SELECT topic, topic || ' ' ||
        string_agg(term || ':' || {_decimals('x', _places)}, ' ' ORDER BY x DESC, term_id) AS value
        FROM (SELECT topic, term_id, term, {_value} AS x FROM mt JOIN mk USING (topic) JOIN vocab USING (term_id))
        GROUP BY topic""")
oracle("topic_terms_text", "mt vocab", f"""SELECT topic, term, term || ':' || {_decimals('cnt', 2)} AS pair
    FROM mt JOIN vocab USING (term_id)""")
oracle("topic_terms_table", "mt vocab", """SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY cnt DESC, term_id) - 1 AS rank,
    term_id, term, cnt AS value FROM mt JOIN vocab USING (term_id)""")
oracle("frequent_vocab", "w", """SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term
    FROM (SELECT term FROM w GROUP BY term HAVING count(*) >= 10)""")
oracle("doc_topics_report", "dt", f"""SELECT row_index, row_index || ' ' || doc_id || ' ' || topics AS value
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index,
        string_agg(topic || ':' || {_decimals('prob', 6)}, ' ' ORDER BY prob DESC, topic) AS topics
        FROM (SELECT doc_id, topic, cnt / sum(cnt) OVER (PARTITION BY doc_id) AS prob FROM dt) GROUP BY doc_id)""")
oracle("model_dir", "perp", f"""SELECT printf('LDAModel_%.2f_%.2f_%.2f_%.2f_20_5_', {ALPHA}::DOUBLE, {BETA}::DOUBLE,
    {ALPHA_AS}::DOUBLE, perplexity) AS name FROM perp""")
oracle("save_model", "mt vocab", "SELECT term_id, term, topic, cnt FROM mt JOIN vocab USING (term_id)")

# projections, filters, predicates
oracle("three_fields", "", _FIELDS)
oracle("select_docs", "lines", """SELECT value FROM lines
    WHERE string_split(value, ' ')[1] IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1)""")
oracle("truncated_counts", "bow", "SELECT doc_id, term_id, cnt - 1 AS cnt FROM bow WHERE cnt > 1")
oracle("tokens", "occ", "SELECT doc_id, term_id, occ FROM occ")
oracle("positive_counts", "tt", "SELECT term_id, topic, cnt - 2 AS cnt FROM tt WHERE cnt > 2")
oracle("balanced_text", "", r"""WITH word AS (
        SELECT page_id, unnest(regexp_split_to_array(html, '\s+')) AS token FROM pages),
    turned AS (
        SELECT page_id, CASE WHEN page_id % 2 = 1 THEN reverse(token) ELSE token END AS t
        FROM word WHERE regexp_matches(token, '[()]')),
    input AS MATERIALIZED (
        SELECT row_number() OVER () AS i, kind, id, text FROM (
            SELECT 'document' AS kind, doc_id AS id, text FROM documents
            UNION ALL SELECT 'page', page_id, html FROM pages
            UNION ALL SELECT 'token', page_id, CASE WHEN page_id % 3 = 0 THEN substr(t, 1, length(t) - 1) ELSE t END FROM turned)),
    step AS (
        SELECT i, pos, CASE c WHEN '(' THEN 1 ELSE -1 END AS move
        FROM (SELECT i, unnest(string_split(b, '')) AS c, generate_subscripts(string_split(b, ''), 1) AS pos
            FROM (SELECT i, regexp_replace(text, '[^()]', '', 'g') AS b FROM input)) WHERE c IN ('(', ')')),
    depth AS (SELECT i, sum(move) OVER (PARTITION BY i ORDER BY pos) AS d FROM step),
    bad AS (
        SELECT i FROM depth GROUP BY i HAVING min(d) < 0
        UNION SELECT i FROM step GROUP BY i HAVING sum(move) <> 0)
    SELECT kind, id, text, i NOT IN (SELECT i FROM bad) AS ok FROM input""")

# sampling and joins
_SAMPLE = "(SELECT {c} AS value FROM {t} ORDER BY md5(concat_ws('|', " + str(SEED) + ", {c})), {c} LIMIT {n})"
oracle("sample_docs", "", _SAMPLE.format(c="text", t="documents", n=100))
oracle("sample_docs_large", "", _SAMPLE.format(c="text", t="documents", n=300))
oracle("holdout_split", "", f"""WITH held AS MATERIALIZED {_SAMPLE.format(c='text', t='documents', n=50)}
    SELECT text AS value, 'training' AS part FROM documents WHERE text NOT IN (SELECT value FROM held)
    UNION ALL SELECT value, 'held out' FROM held""")
oracle("sample_and_select", "lines", f"""SELECT value FROM {_SAMPLE.format(c='value', t='lines', n=50)}
    UNION SELECT value FROM lines WHERE string_split(value, ' ')[1] IN ('1', '5', '17')""")
oracle("accumulate", "tt tt2", """SELECT term_id, topic, sum(cnt)::BIGINT AS cnt
    FROM (SELECT * FROM tt UNION ALL SELECT * FROM tt2) GROUP BY term_id, topic""")
oracle("triplets", "bow dt tt", """SELECT doc_id, term_id, bow.cnt AS n, topic, dt.cnt AS n_dk, coalesce(tt.cnt, 0) AS n_kw
    FROM bow JOIN dt USING (doc_id) LEFT JOIN tt USING (term_id, topic)""")
for _name in ("vocabulary_term", "vocabulary_index"):
    oracle(_name, "bow", "SELECT doc_id, term_id, cnt, term FROM bow JOIN vocab USING (term_id)")
oracle("relabel", "e", """SELECT doc_id, term_id, occ,
    CASE topic WHEN 1 THEN 0 WHEN 5 THEN 2 WHEN 7 THEN 1 ELSE topic END AS topic FROM e""")

# counters
oracle("doc_topic", "dt", "SELECT doc_id, topic, cnt FROM dt")
oracle("term_topic", "tt", "SELECT term_id, topic, cnt FROM tt")
oracle("topic_total", "nk", f"SELECT topic, cnt FROM nk UNION ALL SELECT {TOPICS}, 0")
oracle("num_docs", "bow", "SELECT count(DISTINCT doc_id) AS num_docs FROM bow")
oracle("num_tokens", "bow", "SELECT sum(cnt)::BIGINT AS num_tokens FROM bow")
oracle("check_totals", "bow", "SELECT sum(cnt)::BIGINT AS num_tokens, sum(cnt)::BIGINT AS total_count, true AS ok FROM bow")
oracle("average_counters", "mt", "SELECT term_id, topic, cnt FROM mt")
oracle("averaged_totals", "mk", "SELECT topic, cnt FROM mk")
oracle("merge_models", "tt tt2", """SELECT term_id, topic, cnt, sum(cnt) OVER (PARTITION BY topic) AS total
    FROM (SELECT term_id, topic, sum(cnt)::DOUBLE AS cnt
        FROM (SELECT * FROM tt UNION ALL SELECT * FROM tt2) GROUP BY term_id, topic)""")
oracle("merge_increment", "tt", """SELECT term_id, topic, sum(cnt)::DOUBLE AS cnt
    FROM (SELECT * FROM tt UNION ALL SELECT term_id, 0, 1 FROM vocab) GROUP BY term_id, topic""")
oracle("topic_term", "tt", "SELECT topic, term_id, cnt FROM tt")
oracle("model_stats", "size", f"SELECT {TOPICS} AS num_topics, v::INTEGER AS num_terms, n::DOUBLE AS num_tokens FROM size")

# ranking and prefix sums
oracle("topics_by_total", "mk", "SELECT row_number() OVER (ORDER BY cnt DESC, topic) - 1 AS rank, topic, cnt FROM mk")
oracle("top_terms", "mt vocab", """SELECT * FROM (
    SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY cnt DESC, term) AS INTEGER) AS rank, term, cnt
    FROM mt JOIN vocab USING (term_id)) WHERE rank <= 10""")
oracle("top_topics", "dt", """SELECT doc_id, rank, topic, round(prob, 6) AS prob FROM (
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, topic) AS INTEGER) AS rank, topic,
        cnt / sum(cnt) OVER (PARTITION BY doc_id) AS prob FROM dt) WHERE rank <= 3""")
oracle("row_index", "bow", """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index
    FROM (SELECT DISTINCT doc_id FROM bow)""")
oracle("proposal_cdf_terms", "mt mk size", f"""SELECT term_id, topic, round(sum(mt.cnt / (mk.cnt + v * {BETA}))
    OVER (PARTITION BY term_id ORDER BY topic), 6) AS cdf FROM mt JOIN mk USING (topic), size""")
oracle("proposal_cdf_topics", "nk size", f"""SELECT topic,
    round(sum({BETA} / (cnt + v * {BETA})) OVER (ORDER BY topic), 9) AS smoothing_cdf,
    round(sum({_prior('cnt')}) OVER (ORDER BY topic), 9) AS prior_cdf FROM nk, size""")
oracle("proposal_cdf_docs", "dt", "SELECT doc_id, topic, (sum(cnt) OVER (PARTITION BY doc_id ORDER BY topic))::BIGINT AS cdf FROM dt")

# the topic model's arithmetic
oracle("init_topics", "e", "SELECT doc_id, term_id, occ, topic FROM e")
oracle("as_prior", "nk size", f"""SELECT topic, round({_prior('cnt')}, 9) AS prior, round({_prior('cnt', 1)}, 9) AS prior_own
    FROM nk, size""")
for _name, _weight in (
    ("token_topic_prob", lambda own: f"{_word('n_kw', 'n_k', own)} * {_doc('n_dk', 'n_k', own)}"),
    ("doc_topic_prob", lambda own: _doc("n_dk", "n_k", own)),
    ("word_topic_prob", lambda own: _word("n_kw", "n_k", own)),
):
    oracle(_name, "held", f"""SELECT doc_id, term_id, topic, round({_weight(0)}, 9) AS weight,
        round({_weight(1)}, 9) AS weight_own FROM held""")
_W1, _D1 = _word("w1", "k1", 1), _doc("d1", "k1", 1)
_W2, _D2 = _word("w2", "k2"), _doc("d2", "k2")
oracle("mh_acceptance", "e dt tt nk size", f"""SELECT doc_id, term_id, occ, topic, proposal,
    round(CASE WHEN proposal = topic THEN 1.0 ELSE least(1.0, ({_W2} * {_D2} * q1) / ({_W1} * {_D1} * q2)) END, 6)::DOUBLE AS acceptance
    FROM (SELECT *, CASE WHEN by_doc THEN {_D1} ELSE {_W1} END AS q1, CASE WHEN by_doc THEN {_D2} ELSE {_W2} END AS q2
    FROM (SELECT t.doc_id, t.term_id, t.occ, t.topic, t.proposal, t.by_doc, v, n, a.cnt AS d1, b.cnt AS w1, c.cnt AS k1,
        coalesce(x.cnt, 0) AS d2, coalesce(y.cnt, 0) AS w2, z.cnt AS k2
    FROM (SELECT *, CAST({_UNIFORM.format(f'{SEED}, 1')} % {TOPICS} AS INTEGER) AS proposal,
            {_UNIFORM.format(f'{SEED}, 2')} % 2 = 0 AS by_doc FROM e) t
        JOIN dt a ON a.doc_id = t.doc_id AND a.topic = t.topic JOIN tt b ON b.term_id = t.term_id AND b.topic = t.topic
        JOIN nk c ON c.topic = t.topic JOIN nk z ON z.topic = t.proposal
        LEFT JOIN dt x ON x.doc_id = t.doc_id AND x.topic = t.proposal
        LEFT JOIN tt y ON y.term_id = t.term_id AND y.topic = t.proposal, size))""")
oracle("frozen_sweep", "e dt tt nk size", f"""SELECT doc_id, term_id, occ, topic, min(k) AS new FROM (
    SELECT *, sum(weight) OVER (PARTITION BY doc_id, term_id, occ ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf,
        sum(weight) OVER (PARTITION BY doc_id, term_id, occ) * u AS goal
    FROM (SELECT t.doc_id, t.term_id, t.occ, t.topic, z.topic AS k, {_UNIFORM.format(f'{SEED}, 1').replace("doc_id", "t.doc_id").replace("term_id", "t.term_id").replace("occ)", "t.occ)")} / pow(2, 52) AS u,
        CASE WHEN z.topic = t.topic THEN {_word('coalesce(y.cnt, 0)', 'z.cnt', 1)} * {_doc('coalesce(x.cnt, 0)', 'z.cnt', 1)}
            ELSE {_word('coalesce(y.cnt, 0)', 'z.cnt')} * {_doc('coalesce(x.cnt, 0)', 'z.cnt')} END AS weight
    FROM e t JOIN nk z ON true LEFT JOIN dt x ON x.doc_id = t.doc_id AND x.topic = z.topic
        LEFT JOIN tt y ON y.term_id = t.term_id AND y.topic = z.topic, size))
    WHERE cdf >= goal GROUP BY doc_id, term_id, occ, topic""")
oracle("doc_topic_dist", "dt", "SELECT doc_id, topic, round(cnt / sum(cnt) OVER (PARTITION BY doc_id), 6) AS prob FROM dt")
oracle("perplexity", "perp", "SELECT round(perplexity, 6) AS perplexity FROM perp")
oracle("perplexity_compat", "perp", "SELECT round(compat, 6) AS perplexity FROM perp")
oracle("topic_similarity", "sim", "SELECT topic_a, topic_b, round(sim, 6) AS sim FROM sim")
oracle("min_similar_topic", "near", "SELECT topic, target FROM near")
oracle("merge_duplicate_topics", "tt near", """SELECT term_id, topic, sum(cnt)::BIGINT AS cnt FROM (
    SELECT term_id, coalesce(target, topic) AS topic, cnt FROM tt LEFT JOIN near USING (topic)) GROUP BY term_id, topic""")
oracle("empty_model", "vocab ks", f"""SELECT topic, count(term)::DOUBLE AS cnt, 1.0::DOUBLE AS alpha_as, 9999999.0::DOUBLE AS perplexity
    FROM ks LEFT JOIN vocab ON length(term) % {TOPICS} = topic GROUP BY topic""")

# sampling: what must hold whatever is drawn
oracle("gibbs_sweep", "bow", "SELECT *, true AS ok FROM bow")
oracle("run_gibbs", "perp", "SELECT range::INTEGER AS iter, round(perplexity, 6) AS first, true AS improved FROM perp, range(1, 4)")
_PER_TERM = "SELECT term_id, sum(cnt)::DOUBLE AS cnt, true AS ok FROM bow GROUP BY term_id"
oracle("train", "bow", _PER_TERM)
oracle("train_incremental", "size", f"""SELECT {TOPICS} AS num_topics, v::INTEGER AS num_terms, n::DOUBLE AS num_tokens,
        true AS improved FROM size""")
oracle("save_averaged", "bow", _PER_TERM)
oracle("init_topics_from_model", "bow", "SELECT *, true AS ok FROM bow")
oracle("infer", "bow", "SELECT DISTINCT doc_id, 1.0::DOUBLE AS total, true AS ok FROM bow")
oracle("run_inference", "bow", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, doc_id, true AS ok FROM (SELECT DISTINCT doc_id FROM bow)")
oracle("infer_stream", "bow", "SELECT DISTINCT doc_id, true AS ok FROM bow")
