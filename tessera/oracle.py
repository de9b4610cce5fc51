"""Independent DuckDB SQL for every oracle-checked query.

The fixture views are written once here as CTEs (same definitions as
``tessera.sources.tables``) and each query names the views it needs; the
assembled statement is plain SQL over the pre-registered driver tables.
"""

from __future__ import annotations

from tessera.functions.stopwords import ENGLISH
from tessera.operators.labelling import STYLE

SPLIT = ("list_filter(string_split(regexp_replace({x}, '([.!?])[ \\t\\n\\r\\f]+', "
         "'\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')")
WS = "[ \\t\\n\\r\\f\\x0B]"


def split_sql(x: str) -> str:
    return SPLIT.format(x=x)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def blank_sql(x: str) -> str:
    return f"({x} IS NULL OR regexp_matches({x}, '^{WS}*$'))"


def stop_list_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "]"


def event_raw_sql() -> str:
    return ("CASE WHEN event_id % 11 = 0 THEN 0 ELSE CASE event_type WHEN 'click' THEN 1 "
            "WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END END")


def collapse_sql(x: str) -> str:
    return f"CASE {x} WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 ELSE {x} END"


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTE[name] = (deps, body)


def with_views(final: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + final


# ---------------------------------------------------------------- fixtures
cte("articles", (), """
  SELECT doc_id AS paper_id, source AS domain,
         CAST(DATE '2018-07-01' + CAST(doc_id % 31 AS INTEGER) AS DATE) AS date, text
  FROM documents""")

cte("art_split", ("articles",), f"""
  SELECT paper_id, domain, date, {split_sql('text')} AS sents FROM articles""")

cte("sentences", ("art_split",), """
  SELECT paper_id, domain, date, pos, text,
         CAST(row_number() OVER (ORDER BY paper_id, pos) - 1 AS BIGINT) AS sentence_id
  FROM (SELECT paper_id, domain, date, unnest(sents) AS text,
               CAST(unnest(range(len(sents))) AS INTEGER) AS pos FROM art_split)""")

cte("votes", (), f"""
  SELECT event_id, CAST(event_id // 3 AS BIGINT) AS task, user_id AS worker,
         CAST({event_raw_sql()} AS INTEGER) AS raw,
         CAST({collapse_sql(event_raw_sql())} AS INTEGER) AS label
  FROM events""")

cte("raters", ("votes",), """
  SELECT task AS sentence_id, arg_min(raw, event_id) AS score, arg_max(raw, event_id) AS opp_score
  FROM votes GROUP BY task""")

cte("binary_predictions", (), """
  SELECT d.doc_id, d.text, l.quality AS score, l.toxic AS pred
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

cte("epochs", (), """
  SELECT user_id AS run, ts, event_id, value AS f1,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch
  FROM events""")

cte("scores3", (), """
  SELECT vec_id, probs, CAST(label % 3 AS INTEGER) AS score FROM (
    SELECT vec_id, label,
           [exp(embedding[1]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE)),
            exp(embedding[2]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE)),
            exp(embedding[3]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE))] AS probs
    FROM embeddings)""")

# ---------------------------------------------------------------- curation
CURATION = dict(min_sources=44, budget=5000)

cte("cur_clean", ("articles",), f"""
  SELECT paper_id, domain, date, text, CAST(len({split_sql('text')}) AS INTEGER) AS length
  FROM articles
  WHERE NOT {blank_sql('text')} AND NOT {blank_sql('domain')} AND date IS NOT NULL""")

cte("cur_len", ("cur_clean",), "SELECT * FROM cur_clean WHERE length >= 5")

cte("cur_dedup", ("cur_len",), """
  SELECT paper_id, domain, date, text, length FROM cur_len
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY domain, paper_id) = 1""")

cte("cur_sources", ("cur_dedup",), f"""
  SELECT domain, CAST(count(*) AS BIGINT) AS n_articles FROM cur_dedup GROUP BY domain
  HAVING count(*) > {CURATION['min_sources']}""")

cte("cur_kept", ("cur_dedup", "cur_sources"), """
  SELECT * FROM cur_dedup WHERE domain IN (SELECT domain FROM cur_sources)""")

cte("cur_budget", ("cur_kept",), f"""
  SELECT paper_id, domain, date, text, length, CAST(cum - length AS BIGINT) AS first_sentence FROM (
    SELECT *, sum(length) OVER (ORDER BY date DESC, domain DESC, paper_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
    FROM cur_kept) WHERE cum < {CURATION['budget']}""")

cte("curated", ("cur_budget",), f"""
  SELECT paper_id, domain, date, sentence AS text, CAST(first_sentence + pos AS BIGINT) AS sentence_id
  FROM (SELECT paper_id, domain, date, first_sentence, unnest({split_sql('text')}) AS sentence,
               unnest(range(len({split_sql('text')}))) AS pos FROM cur_budget)""")

# ---------------------------------------------------------------- pools


def context_sql(src: str, before: int, after: int) -> str:
    return f"""
  SELECT s.*,
    coalesce((SELECT string_agg(p.text, ' ' ORDER BY p.sentence_id) FROM {src} p
              WHERE p.paper_id = s.paper_id AND p.sentence_id BETWEEN s.sentence_id - {before}
                AND s.sentence_id - 1), '') AS prev_context,
    coalesce((SELECT string_agg(n.text, ' ' ORDER BY n.sentence_id) FROM {src} n
              WHERE n.paper_id = s.paper_id AND n.sentence_id BETWEEN s.sentence_id + 1
                AND s.sentence_id + {after}), '') AS next_context
  FROM {src} s"""


def window_context_sql(src: str, before: int, after: int) -> str:
    return f"""
  SELECT *,
    coalesce(array_to_string(list(text) OVER (PARTITION BY paper_id ORDER BY sentence_id
             ROWS BETWEEN {before} PRECEDING AND 1 PRECEDING), ' '), '') AS prev_context,
    coalesce(array_to_string(list(text) OVER (PARTITION BY paper_id ORDER BY sentence_id
             ROWS BETWEEN 1 FOLLOWING AND {after} FOLLOWING), ' '), '') AS next_context
  FROM {src}"""


cte("corpus", ("sentences",), "SELECT paper_id, domain, date, text, sentence_id FROM sentences")
cte("pool_ctx", ("corpus",), window_context_sql("corpus", 2, 4))
cte("pool_all", ("pool_ctx",), """
  SELECT *, concat_ws(' ', nullif(prev_context, ''), '**' || text || '**', nullif(next_context, ''))
         AS pool_text FROM pool_ctx""")
cte("honey_papers", ("corpus",), """
  SELECT paper_id FROM corpus GROUP BY paper_id ORDER BY min(sentence_id), paper_id LIMIT 3""")
cte("pilot_papers", ("corpus", "honey_papers"), """
  SELECT paper_id FROM corpus WHERE paper_id NOT IN (SELECT paper_id FROM honey_papers)
  GROUP BY paper_id ORDER BY min(sentence_id), paper_id LIMIT 5""")
cte("pooled", ("pool_all", "honey_papers", "pilot_papers"), """
  SELECT CASE WHEN paper_id IN (SELECT paper_id FROM honey_papers) THEN 'honeypot'
              WHEN paper_id IN (SELECT paper_id FROM pilot_papers) THEN 'pilot'
              ELSE 'full' END AS pool, paper_id, sentence_id, pool_text
  FROM pool_all""")

SQL: dict[str, str] = {}

SQL["pool_build"] = with_views("SELECT pool, paper_id, sentence_id, pool_text FROM pooled", "pooled")

# ---------------------------------------------------------------- votes


def wawa_ctes(p: str, src: str) -> None:
    """Majority vote, worker skill and skill-weighted vote over ``src``
    (task, worker, label) as CTEs named ``{p}_mv``, ``{p}_skill``, ``{p}_wawa``."""
    cte(f"{p}_mv", (src,), f"""
  SELECT task, label FROM (SELECT task, label, count(*) AS n FROM {src} GROUP BY task, label)
  QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC, label) = 1""")
    cte(f"{p}_skill", (src, f"{p}_mv"), f"""
  SELECT v.worker, sum(CASE WHEN v.label = m.label THEN 1 ELSE 0 END)::DOUBLE / count(*) AS skill
  FROM {src} v JOIN {p}_mv m ON v.task = m.task GROUP BY v.worker""")
    cte(f"{p}_wawa", (src, f"{p}_skill"), f"""
  SELECT task, label FROM (
    SELECT v.task, v.label, round(sum(s.skill), 9) AS weight
    FROM {src} v JOIN {p}_skill s ON v.worker = s.worker GROUP BY v.task, v.label)
  QUALIFY row_number() OVER (PARTITION BY task ORDER BY weight DESC, label) = 1""")


def f1_ctes(p: str, src: str, by: str, gold: str, pred: str) -> None:
    """Per-class and macro F1 over classes present in gold or pred, grouped by
    ``by`` (empty string for none): ``{p}_cls`` and ``{p}_macro``."""
    k = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    cte(f"{p}_cls", (src,), f"""
  SELECT {k}cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
         2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM (
    SELECT {k}{gold} AS cls, CASE WHEN {gold} = {pred} THEN 1 ELSE 0 END AS tp, 0 AS fp,
           CASE WHEN {gold} <> {pred} THEN 1 ELSE 0 END AS fn FROM {src}
    UNION ALL
    SELECT {k}{pred} AS cls, 0, 1, 0 FROM {src} WHERE {gold} <> {pred})
  GROUP BY {k}cls""")
    cte(f"{p}_macro", (f"{p}_cls",), f"SELECT {k}avg(f1) AS macro_f1 FROM {p}_cls {g}")


wawa_ctes("v", "votes")
f1_ctes("wf", "votes_gold", "worker", "gold", "label")
cte("votes_gold", ("votes", "v_wawa"), """
  SELECT v.worker, v.task, w.label AS gold, v.label FROM votes v JOIN v_wawa w ON v.task = w.task""")

SQL["votes_majority"] = with_views("SELECT task, label FROM v_mv", "v_mv")
SQL["votes_worker_skill"] = with_views("SELECT worker, round(skill, 9) AS skill FROM v_skill", "v_skill")
SQL["votes_wawa"] = with_views("SELECT task, label FROM v_wawa", "v_wawa")
SQL["votes_unaligned_workers"] = with_views(
    "SELECT worker, round(macro_f1, 9) AS f1 FROM wf_macro WHERE macro_f1 < 0.35", "wf_macro")
SQL["votes_label_distribution"] = with_views("""
  SELECT d.label, d.name, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM (VALUES (0, 'Non-Applicable'), (1, 'Objective'), (2, 'Neutral'), (3, 'Subjective')) d(label, name)
  LEFT JOIN (SELECT label, count(*) AS n FROM v_wawa GROUP BY label) c ON d.label = c.label""", "v_wawa")
SQL["votes_majority_or_median"] = with_views("""
  SELECT task, CAST(CASE WHEN max(n) = 1 THEN trunc(median(label)) ELSE arg_max(label, n * 10 - label) END AS INTEGER) AS label
  FROM (SELECT task, label, count(*) AS n FROM votes GROUP BY task, label) GROUP BY task""", "votes")
SQL["votes_label_histogram"] = with_views("""
  SELECT task, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n0,
         CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n1,
         CAST(count(*) FILTER (WHERE label = 2) AS BIGINT) AS n2,
         CAST(count(*) FILTER (WHERE label = 3) AS BIGINT) AS n3,
         CAST(count(*) FILTER (WHERE label IS NULL OR label NOT IN (0, 1, 2, 3)) AS BIGINT) AS n_other
  FROM votes GROUP BY task""", "votes")
SQL["sentences_canonical_task"] = with_views(
    "SELECT text, min(sentence_id) AS canonical_task FROM sentences GROUP BY text", "sentences")

# crowd results: each vote carries the pool text of its task's sentence
cte("crowd", ("votes", "pool_all"), """
  SELECT v.task, v.worker, v.label, p.pool_text AS text FROM votes v JOIN pool_all p ON v.task = p.sentence_id""")
cte("retrieval", ("pool_all",), "SELECT pool_text, sentence_id FROM pool_all")
wawa_ctes("c", "crowd")
SQL["votes_task_text"] = with_views("""
  SELECT w.task, w.label, t.text FROM c_wawa w LEFT JOIN (SELECT DISTINCT task, text FROM crowd) t
  ON w.task = t.task""", "c_wawa", "crowd")
SQL["votes_retrieve_ids"] = with_views("""
  SELECT r.sentence_id, c.worker, c.label, c.n FROM
    (SELECT text, worker, label, count(*) AS n FROM crowd GROUP BY text, worker, label) c
  JOIN retrieval r ON replace(c.text, chr(13), '') = replace(r.pool_text, chr(13), '')""", "crowd", "retrieval")
SQL["votes_attach_attributes"] = with_views("""
  SELECT w.task, w.label, s.paper_id, s.domain, s.date, s.pos, s.text
  FROM v_wawa w LEFT JOIN sentences s ON w.task = s.sentence_id""", "v_wawa", "sentences")

cte("m14_votes", ("raters", "crowd", "retrieval", "corpus"), f"""
  SELECT k.canonical_task AS task, a.worker, a.label FROM (
    SELECT a.task, a.worker, a.label, s.text FROM (
      SELECT sentence_id AS task, CAST(1000 AS BIGINT) AS worker, {collapse_sql('score')} AS label FROM raters
      UNION ALL
      SELECT r.sentence_id AS task, c.worker, c.label FROM crowd c
      JOIN retrieval r ON replace(c.text, chr(13), '') = replace(r.pool_text, chr(13), '')) a
    JOIN corpus s ON a.task = s.sentence_id) a
  JOIN (SELECT text, min(task) AS canonical_task FROM (
          SELECT a.task, s.text FROM (
            SELECT sentence_id AS task FROM raters
            UNION ALL
            SELECT r.sentence_id FROM crowd c
            JOIN retrieval r ON replace(c.text, chr(13), '') = replace(r.pool_text, chr(13), '')) a
          JOIN corpus s ON a.task = s.sentence_id) GROUP BY text) k ON a.text = k.text""")
wawa_ctes("m14", "m14_votes")
cte("labelled", ("m14_wawa", "corpus"), """
  SELECT w.task, w.label AS score, s.text, s.domain, s.date, s.paper_id
  FROM m14_wawa w LEFT JOIN corpus s ON w.task = s.sentence_id""")
SQL["votes_consolidate"] = with_views("SELECT * FROM labelled", "labelled")

# ---------------------------------------------------------------- metrics
cte("predicted", ("binary_predictions",), "SELECT * FROM binary_predictions WHERE pred IS NOT NULL")
f1_ctes("bp", "predicted", "", "score", "pred")

SQL["metrics_confusion"] = with_views(
    "SELECT score, pred, count(*) AS n FROM predicted GROUP BY score, pred", "predicted")
SQL["metrics_binary_f1"] = with_views("""
  SELECT round(2.0 * sum(CASE WHEN score = 1 AND pred = 1 THEN 1 ELSE 0 END) /
         (2 * sum(CASE WHEN score = 1 AND pred = 1 THEN 1 ELSE 0 END)
          + sum(CASE WHEN score <> 1 AND pred = 1 THEN 1 ELSE 0 END)
          + sum(CASE WHEN score = 1 AND pred <> 1 THEN 1 ELSE 0 END)), 9) AS binary_f1
  FROM predicted""", "predicted")
SQL["metrics_accuracy"] = with_views(
    "SELECT round(avg(CASE WHEN score = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM predicted", "predicted")
SQL["metrics_macro_f1"] = with_views("SELECT round(macro_f1, 9) AS macro_f1 FROM bp_macro", "bp_macro")
SQL["metrics_class_f1"] = with_views(
    "SELECT cls, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, "
    "round(f1, 9) AS f1 FROM bp_cls", "bp_cls")
SQL["metrics_pearson"] = with_views("""
  SELECT round(corr(score, opp_score), 9) AS pearson, count(*) AS n FROM raters
  WHERE score <> 0 AND opp_score <> 0""", "raters")
SQL["metrics_binarise"] = with_views("""
  SELECT sentence_id, CASE WHEN score > 0 THEN 1 ELSE 0 END AS score_applicable,
         CASE WHEN opp_score > 0 THEN 1 ELSE 0 END AS opp_applicable FROM raters""", "raters")
f1_ctes("ag", "raters", "", "score", "opp_score")
SQL["metrics_agreement"] = with_views("""
  SELECT count(*) AS n, CAST(sum(CASE WHEN opp_score IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched,
    round(2.0 * sum(CASE WHEN score > 0 AND opp_score > 0 THEN 1 ELSE 0 END) /
      (2 * sum(CASE WHEN score > 0 AND opp_score > 0 THEN 1 ELSE 0 END)
       + sum(CASE WHEN score = 0 AND opp_score > 0 THEN 1 ELSE 0 END)
       + sum(CASE WHEN score > 0 AND opp_score = 0 THEN 1 ELSE 0 END)), 9) AS binary_f1,
    round(corr(CASE WHEN score <> 0 AND opp_score <> 0 THEN score END,
               CASE WHEN score <> 0 AND opp_score <> 0 THEN opp_score END), 9) AS pearson,
    round(avg(CASE WHEN score = opp_score THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
    round((SELECT macro_f1 FROM ag_macro), 9) AS macro_f1
  FROM raters""", "raters", "ag_macro")
cte("s3pred", ("scores3",), """
  SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred FROM scores3""")
SQL["metrics_argmax"] = with_views("SELECT vec_id, score, pred FROM s3pred", "s3pred")
SQL["metrics_cross_entropy"] = with_views(
    "SELECT round(avg(-ln(probs[score + 1])), 9) AS loss FROM scores3", "scores3")


def ordered_split_sql(src: str, key: str) -> str:
    return f"""
  SELECT *, CASE WHEN r >= m THEN 'test' WHEN r >= m - ceil(m * 0.1) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, n - ceil(n * 0.2) AS m FROM (
    SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS r, count(*) OVER () AS n FROM {src}))"""


def stratified_split_sql(src: str, key: str, score: str = "score", seed: str = "42") -> str:
    return f"""
  SELECT * EXCLUDE (r, n, t), CASE WHEN r < t THEN 'test' WHEN r < t + round((n - t) * 0.1) THEN 'val'
                          ELSE 'train' END AS split
  FROM (SELECT *, round(n * 0.2) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY {score}
                 ORDER BY md5(concat_ws('-', '{seed}', CAST({key} AS VARCHAR))), {key}) - 1 AS r,
           count(*) OVER (PARTITION BY {score}) AS n FROM {src}))"""


cte("s3split", ("s3pred",), ordered_split_sql("s3pred", "vec_id"))
f1_ctes("s3f", "s3split", "split", "score", "pred")
SQL["metrics_evaluate"] = with_views("""
  SELECT a.split, a.n, round(a.accuracy, 9) AS accuracy, round(f.macro_f1, 9) AS macro_f1,
         round(a.loss, 9) AS loss
  FROM (SELECT split, count(*) AS n, avg(CASE WHEN score = pred THEN 1.0 ELSE 0.0 END) AS accuracy,
               avg(-ln(probs[score + 1])) AS loss FROM s3split GROUP BY split) a
  JOIN s3f_macro f ON a.split = f.split""", "s3split", "s3f_macro")

# ---------------------------------------------------------------- dataset preparation
cte("lab_split", ("labelled",), stratified_split_sql("labelled", "task"))
cte("lab_ordered", ("labelled",), ordered_split_sql("labelled", "task"))
SQL["split_stratified"] = with_views("SELECT task, score, split FROM lab_split", "lab_split")
SQL["split_ordered"] = with_views("SELECT task, score, split FROM lab_ordered", "lab_ordered")
cte("lab_const", ("lab_split",), "SELECT split, score, 1 AS pred FROM lab_split")
f1_ctes("cb", "lab_const", "split", "score", "pred")
SQL["metrics_constant_baseline"] = with_views("""
  SELECT a.split, round(a.accuracy, 9) AS accuracy, round(f.macro_f1, 9) AS macro_f1
  FROM (SELECT split, avg(CASE WHEN score = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM lab_const GROUP BY split) a
  JOIN cb_macro f ON a.split = f.split""", "lab_const", "cb_macro")
cte("lab_train", ("lab_split",), "SELECT * FROM lab_split WHERE split = 'train'")
SQL["downsample_majority"] = with_views("""
  SELECT task, score FROM lab_train WHERE score <> 1
  UNION ALL
  SELECT task, score FROM (SELECT task, score, row_number() OVER (ORDER BY task) - 1 AS r
                           FROM lab_train WHERE score = 1)
  WHERE r < (SELECT count(*) FROM lab_train WHERE score = 3)""", "lab_train")
SQL["class_filter"] = with_views("SELECT task, score FROM labelled WHERE score <> 2", "labelled")
SQL["neighbour_context"] = with_views("""
  SELECT s.task, s.split, s.paper_id, concat_ws(' ', p.text, s.text, n.text) AS text
  FROM lab_ordered s
  LEFT JOIN lab_ordered p ON p.split = s.split AND p.paper_id = s.paper_id AND p.task = s.task - 1
  LEFT JOIN lab_ordered n ON n.split = s.split AND n.paper_id = s.paper_id AND n.task = s.task + 1""",
                                      "lab_ordered")
cte("pair_votes", ("votes",), """
  SELECT task, CASE raw % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'neutral' ELSE 'entailment' END AS name
  FROM votes""")
cte("pairs", ("pair_votes", "sentences"), """
  SELECT g.task AS pair_id, CASE WHEN g.n >= 2 THEN g.name ELSE '-' END AS gold_label,
         s1.text AS sentence1, s2.text AS sentence2
  FROM (SELECT task, arg_max(name, n * 1000 + CASE name WHEN 'neutral' THEN 2 WHEN 'entailment' THEN 1 ELSE 3 END) AS name,
               max(n) AS n
        FROM (SELECT task, name, count(*) AS n FROM pair_votes GROUP BY task, name) GROUP BY task) g
  LEFT JOIN sentences s1 ON s1.sentence_id = g.task
  LEFT JOIN sentences s2 ON s2.sentence_id = g.task + 1""")
cte("pair_consensus", ("pair_votes",), """
  SELECT task, median(v) AS med FROM (
    SELECT task, v, n, max(n) OVER (PARTITION BY task) AS top FROM (
      SELECT task, CASE name WHEN 'entailment' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END AS v, count(*) AS n
      FROM pair_votes GROUP BY task, name)) WHERE n = top GROUP BY task""")
SQL["consensus_labels"] = with_views("""
  SELECT p.pair_id, p.gold_label,
         CAST(CASE WHEN p.gold_label = '-' THEN c.med
              ELSE CASE p.gold_label WHEN 'entailment' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END END AS DOUBLE) AS score,
         replace(concat_ws(' ', p.sentence1, p.sentence2), '"', '') AS text
  FROM pairs p LEFT JOIN pair_consensus c ON p.pair_id = c.task""", "pairs", "pair_consensus")
cte("sent_ordered", ("sentences",), ordered_split_sql("sentences", "sentence_id"))
SQL["split_integrity"] = with_views("""
  SELECT text, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM sent_ordered
  GROUP BY text HAVING count(DISTINCT split) > 1""", "sent_ordered")
SQL["union_splits"] = with_views("""
  SELECT task, score, split FROM lab_split WHERE split IN ('train', 'val')
  UNION ALL SELECT task, NULL AS score, split FROM lab_split WHERE split = 'test'""", "lab_split")
SQL["distinct_texts"] = with_views("SELECT DISTINCT text FROM sentences", "sentences")
SQL["difference_pools"] = with_views("""
  SELECT paper_id, sentence_id FROM corpus WHERE paper_id NOT IN (SELECT paper_id FROM honey_papers)""",
                                     "corpus", "honey_papers")
SQL["canonical_schema"] = """
  SELECT CAST(d.text AS VARCHAR) AS text, CAST(l.quality AS DOUBLE) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
SQL["recode_votes"] = with_views("SELECT event_id, raw, label FROM votes", "votes")
SQL["error_extraction"] = """
  SELECT d.doc_id, d.text, l.quality AS score, l.toxic AS pred
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE l.toxic IS NOT NULL AND l.quality <> CAST(l.toxic AS INTEGER)
  ORDER BY d.doc_id LIMIT 100"""

# ---------------------------------------------------------------- features
cte("tokens", (), f"""
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z]+'),
                             lambda t: NOT list_contains({stop_list_sql()}, t)) AS tokens
  FROM documents""")
cte("tok_rows", ("tokens",), """
  SELECT doc_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM tokens""")
cte("tf", ("tok_rows",), "SELECT doc_id, term, count(*) AS tf FROM tok_rows GROUP BY doc_id, term")
cte("doc_split", ("predicted",), stratified_split_sql(
    "(SELECT doc_id, text, score FROM predicted)", "doc_id"))
cte("train_docs", ("doc_split",), "SELECT doc_id FROM doc_split WHERE split = 'train'")
cte("idf", ("tf", "train_docs"), """
  SELECT term, ln((1 + (SELECT count(*) FROM train_docs)) / (1 + count(*))) + 1 AS idf
  FROM tf WHERE doc_id IN (SELECT doc_id FROM train_docs) GROUP BY term""")
cte("tfidf_raw", ("tf", "idf"), "SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term")
SQL["tokens_words"] = with_views(
    "SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM tokens",
    "tokens")
SQL["tfidf_weights"] = with_views("""
  SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM tfidf_raw""",
                                  "tfidf_raw")
cte("vocab", ("tf",), """
  SELECT term, CAST(row_number() OVER (ORDER BY count(*) DESC, term) - 1 + 4 AS BIGINT) AS id
  FROM tf GROUP BY term""")
SQL["vocabulary_ids"] = with_views("SELECT term, id FROM vocab", "vocab")
cte("encoded", ("tokens", "tok_rows", "vocab"), """
  SELECT doc_id, coalesce(ids, []) AS ids FROM tokens LEFT JOIN (
    SELECT t.doc_id, list(v.id ORDER BY t.pos) AS ids FROM tok_rows t JOIN vocab v ON t.term = v.term
    GROUP BY t.doc_id) USING (doc_id)""")
SQL["token_length_cap"] = with_views(
    "SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids FROM encoded WHERE len(ids) + 2 <= 512", "encoded")
SQL["padded_batches"] = with_views("""
  SELECT doc_id, batch_id, width,
         array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ' ') AS padded
  FROM (SELECT *, CAST(max(len(ids)) OVER (PARTITION BY batch_id) AS INTEGER) AS width FROM (
    SELECT doc_id, list_concat([2], ids, [3]) AS ids,
           CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch_id
    FROM encoded))""", "encoded")

# ---------------------------------------------------------------- labelling
ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]


def clean_sql(x: str) -> str:
    s = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for a, b in ENT:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"translate({s}, '‘’“”', '''''\"\"')"
    return strip_sql(s)


BODY = "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
cte("page_articles", (), f"""
  SELECT page_id AS article_id,
    coalesce(nullif({clean_sql("regexp_extract(" + BODY + ", '(?s)<h1[^>]*>(.*?)</h1>', 1)")}, ''),
             nullif({clean_sql("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")}, '')) AS title,
    nullif(regexp_extract(html, '<img[^>]*src=\"([^\"]*)\"', 1), '') AS image_url,
    list_filter(list_transform(string_split_regex(regexp_replace({BODY}, '(?s)<h1[^>]*>(.*?)</h1>', '', 'g'),
                               '(?i)</?p([ \\t\\n\\r\\f][^>]*)?>|<br[ \\t\\n\\r\\f]*/?>'),
                               lambda p: {clean_sql('p')}), lambda p: p <> '') AS paragraphs
  FROM pages""")
cte("page_paras", ("page_articles",), """
  SELECT article_id, CAST(unnest(range(len(paragraphs))) AS INTEGER) AS para_no, unnest(paragraphs) AS text
  FROM page_articles""")
cte("page_sents", ("page_paras",), f"""
  SELECT article_id, para_no, CAST(unnest(range(len(s))) AS INTEGER) AS sent_no, unnest(s) AS text
  FROM (SELECT article_id, para_no, {split_sql('text')} AS s FROM page_paras)""")
cte("page_runs", ("page_sents",), """
  SELECT article_id, para_no, CAST(run_no AS BIGINT) AS run_no, CAST(any_value(pred) AS INTEGER) AS pred,
         string_agg(text, ' ' ORDER BY sent_no) AS text
  FROM (SELECT *, sum(chg) OVER (PARTITION BY article_id, para_no ORDER BY sent_no
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_no
        FROM (SELECT *, CASE WHEN lag(pred) OVER (PARTITION BY article_id, para_no ORDER BY sent_no) = pred
                             THEN 0 ELSE 1 END AS chg
              FROM (SELECT *, CAST(length(text) % 4 AS INTEGER) AS pred FROM page_sents)))
  GROUP BY article_id, para_no, run_no""")
STYLE_SQL = STYLE.replace("'", "''")  # quoted SQL of the operator's own style sheet
cte("page_html", ("page_runs", "page_articles"), f"""
  SELECT a.article_id,
    '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<title>'
    || coalesce(a.title, 'Labeled text') || '</title>' || chr(10) || '<style>' || chr(10) || '{STYLE_SQL}' || chr(10)
    || '</style>' || chr(10) || '<meta content="text/html;charset=utf-8" http-equiv="Content-Type">' || chr(10)
    || '<meta content="utf-8" http-equiv="encoding">' || chr(10) || '</head>' || chr(10) || chr(10) || '<body>'
    || coalesce(chr(10) || '<h1>' || a.title || '</h1>', '')
    || coalesce(chr(10) || '<img src="' || a.image_url || '">', '')
    || coalesce(b.body, '') || '</body>' || chr(10) || '</html>' || chr(10) AS html
  FROM page_articles a LEFT JOIN (
    SELECT article_id, string_agg(p, '' ORDER BY para_no) AS body FROM (
      SELECT article_id, para_no, '<p>' || chr(10) || string_agg(
               CASE pred WHEN 1 THEN '<span class="green-background">' || text || '</span>'
                         WHEN 2 THEN '<span class="yellow-background">' || text || '</span>'
                         WHEN 3 THEN '<span class="red-background">' || text || '</span>'
                         ELSE text END || ' ', '' ORDER BY run_no) || chr(10) || '</p>' || chr(10) AS p
      FROM page_runs GROUP BY article_id, para_no) GROUP BY article_id) b ON a.article_id = b.article_id""")
SQL["page_titles"] = with_views(
    "SELECT article_id, title, image_url, CAST(len(paragraphs) AS INTEGER) AS n_paragraphs FROM page_articles",
    "page_articles")
SQL["page_paragraphs"] = with_views("SELECT * FROM page_paras", "page_paras")
SQL["page_sentences"] = with_views("SELECT * FROM page_sents", "page_sents")
SQL["label_spans"] = with_views("SELECT * FROM page_runs", "page_runs")
SQL["score_sentences"] = with_views(
    "SELECT article_id, para_no, sent_no, CAST(length(text) % 4 AS INTEGER) AS pred FROM page_sents", "page_sents")
SQL["label_pages"] = with_views("""
  SELECT article_id, pred, count(*) AS n_spans, CAST(sum(length(text)) AS BIGINT) AS n_chars
  FROM page_runs GROUP BY article_id, pred""", "page_runs")
SQL["recode_texts"] = """
  SELECT conv_id, turn, CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS INTEGER) AS score
  FROM conversations"""
SQL["paired_texts"] = """
  SELECT a.conv_id, a.turn, CASE a.conv_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
         replace(concat_ws(' ', a.text, b.text), '"', '') AS text,
         CAST(CASE a.role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS DOUBLE) AS score
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
SQL["render_html"] = with_views("SELECT article_id, html FROM page_html", "page_html")
SQL["article_lines"] = f"""
  SELECT article_id, para_no, text FROM (
    SELECT doc_id AS article_id, CAST(unnest(range(len(l))) AS INTEGER) AS para_no, unnest(l) AS text FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
               lambda x: {strip_sql("translate(x, '‘’“”', '''''\"\"')")}), lambda x: x <> '') AS l
      FROM documents))"""
SQL["scan_articles"] = with_views(
    "SELECT paper_id, domain, date, CAST(length(text) AS INTEGER) AS n_chars FROM articles", "articles")
SQL["curate_articles"] = with_views(
    "SELECT paper_id, domain, date, length, first_sentence FROM cur_budget", "cur_budget")
SQL["curated_sentences"] = with_views("SELECT * FROM curated", "curated")
SQL["sentence_numbering"] = with_views("SELECT paper_id, pos, sentence_id FROM sentences", "sentences")
SQL["sources_over_threshold"] = with_views(f"""
  SELECT domain, CAST(count(*) AS BIGINT) AS n_articles FROM articles
  WHERE NOT {blank_sql('text')} AND NOT {blank_sql('domain')} GROUP BY domain HAVING count(*) > {CURATION['min_sources']}""", "articles")
cte("ann_ctx", ("corpus",), window_context_sql("corpus", 2, 3))
SQL["annotator_context"] = with_views("SELECT sentence_id, prev_context, next_context FROM ann_ctx", "ann_ctx")
SQL["annotation_queue"] = with_views("""
  SELECT sentence_id, text, prev_context, next_context FROM ann_ctx
  WHERE sentence_id > (SELECT coalesce(max(sentence_id), -1) FROM raters)""", "ann_ctx", "raters")
SQL["honeypot_gold"] = with_views("""
  SELECT p.sentence_id, p.pool_text, CASE WHEN coalesce(g.n, 0) = 1 THEN g.score END AS gold,
         CAST(coalesce(g.n, 0) AS BIGINT) AS n_gold
  FROM pooled p LEFT JOIN (SELECT sentence_id, count(*) AS n, min(score) AS score FROM raters GROUP BY sentence_id) g
  ON p.sentence_id = g.sentence_id WHERE p.pool = 'honeypot'""", "pooled", "raters")
SQL["pilot_papers"] = with_views("""
  SELECT paper_id, min(sentence_id) AS first_seen FROM corpus GROUP BY paper_id
  ORDER BY first_seen, paper_id LIMIT 5""", "corpus")

# ---------------------------------------------------------------- experiments
cte("best", ("epochs",), """
  SELECT run, arg_min(epoch, (-f1, epoch)) AS best_epoch, max(f1) AS best_f1, max(epoch) AS last_epoch,
         count(*) AS n_epochs FROM epochs GROUP BY run""")
SQL["best_epoch"] = with_views("SELECT * FROM best", "best")
SQL["experiment_comparison"] = with_views("""
  SELECT run, best_epoch, best_f1, round(best_f1 - (SELECT max(best_f1) FROM best WHERE run = 0), 9) AS delta
  FROM best""", "best")
SQL["epoch_numbers"] = with_views("SELECT run, event_id, epoch FROM epochs", "epochs")

cte("consensus", ("pairs", "pair_consensus"), """
  SELECT p.pair_id, CAST(CASE WHEN p.gold_label = '-' THEN c.med
              ELSE CASE p.gold_label WHEN 'entailment' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END END AS DOUBLE) AS score,
         replace(concat_ws(' ', p.sentence1, p.sentence2), '"', '') AS text
  FROM pairs p LEFT JOIN pair_consensus c ON p.pair_id = c.task""")
cte("pair_split", ("consensus",), ordered_split_sql("consensus", "pair_id"))
SQL["multitask_corpus"] = with_views("""
  SELECT task_name, type, num_labels, split, text, score,
         (type <> 'classification' OR (score >= 0 AND score < num_labels)) AND score IS NOT NULL AS valid
  FROM (SELECT 'subjectivity' AS task_name, 'classification' AS type, 4 AS num_labels, split, text,
               CAST(score AS DOUBLE) AS score FROM lab_split
        UNION ALL SELECT 'quality', 'classification', 2, split, text, CAST(score AS DOUBLE) FROM doc_split
        UNION ALL SELECT 'pairs', 'regression', 1, split, text, score FROM pair_split)""",
                                     "lab_split", "doc_split", "pair_split")

# ---------------------------------------------------------------- remaining inventory rows
SQL["rater_join"] = with_views("""
  SELECT a.task AS sentence_id, a.score, b.opp_score FROM
    (SELECT task, arg_min(raw, event_id) AS score FROM votes GROUP BY task) a
  LEFT JOIN (SELECT task, arg_max(raw, event_id) AS opp_score FROM votes GROUP BY task HAVING count(*) > 1) b
  ON a.task = b.task""", "votes")
SQL["source_counts"] = with_views(
    "SELECT domain, count(*) AS n FROM articles GROUP BY domain ORDER BY n DESC, domain", "articles")
SQL["null_profile"] = with_views("""
  SELECT score IS NULL AS score_is_null, pred IS NULL AS pred_is_null, count(*) AS n
  FROM binary_predictions GROUP BY 1, 2""", "binary_predictions")
SQL["dedup_texts"] = with_views("""
  SELECT paper_id, domain FROM articles
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY domain, paper_id) = 1""", "articles")
SQL["blank_filter"] = f"""
  SELECT conv_id, turn, role FROM conversations
  WHERE NOT {blank_sql('text')} AND NOT {blank_sql('role')}"""
SQL["curation_rank"] = with_views("""
  SELECT paper_id, CAST(row_number() OVER (ORDER BY date DESC, domain DESC, paper_id) - 1 AS BIGINT) AS rank
  FROM articles""", "articles")
SQL["first_per_class"] = with_views("""
  SELECT task, score FROM labelled QUALIFY row_number() OVER (PARTITION BY score ORDER BY task) <= 100""",
                                    "labelled")
cte("pe_first", ("predicted",), "SELECT * FROM predicted ORDER BY doc_id LIMIT 1000")
f1_ctes("pe", "pe_first", "", "score", "pred")
SQL["prefix_evaluation"] = with_views("""
  SELECT count(*) AS n, round(avg(CASE WHEN score = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
         round((SELECT macro_f1 FROM pe_macro), 9) AS macro_f1 FROM pe_first""", "pe_first", "pe_macro")
SQL["flatten_sentences"] = with_views(f"""
  SELECT article_id, CAST(len(flatten(list_transform(paragraphs, lambda p: {split_sql('p')}))) AS INTEGER) AS n_sentences
  FROM page_articles""", "page_articles")
SQL["zip_votes"] = with_views("SELECT task, label, worker FROM votes", "votes")
SQL["keep_literal_labels"] = with_views(
    "SELECT event_id, worker, label FROM votes WHERE label IN (1, 3)", "votes")


# ---------------------------------------------------------------- file sources and sinks on table data
def one_line_sql(x: str) -> str:
    return f"regexp_replace({x}, '[\\t\\r\\n\\x0B\\f\\x1C-\\x1F\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g')"


SQL["csv_articles"] = "SELECT doc_id, source, text FROM documents"
SQL["tsv_turns"] = f"SELECT conv_id, turn, {one_line_sql('text')} AS text FROM conversations"
SQL["positional_pairs"] = f"""
  SELECT replace({strip_sql(one_line_sql('source'))} || ' ' || {strip_sql(one_line_sql('text'))}, '"', '') AS text,
         n_chars::DOUBLE AS score FROM documents"""
SQL["jsonl_pairs"] = with_views("""
  SELECT p.gold_label, CAST(v.n AS INTEGER) AS n_labels, replace(concat_ws(' ', p.sentence1, p.sentence2), '"', '') AS text
  FROM pairs p JOIN (SELECT task, count(*) AS n FROM pair_votes GROUP BY task) v ON v.task = p.pair_id""",
                                "pairs", "pair_votes")
SQL["class_files"] = with_views(f"""
  SELECT {strip_sql(one_line_sql('text'))} AS text, score::DOUBLE AS score FROM binary_predictions
  WHERE score IS NOT NULL""", "binary_predictions")
SQL["appended_votes"] = with_views("SELECT task AS sentence_id, raw AS score FROM votes", "votes")

_LETTERS = "CAST(len(regexp_extract_all(text, '{}')) AS DOUBLE)"
SQL["scored_page_sentences"] = with_views(f"""
  SELECT article_id, para_no, sent_no, CASE WHEN length(text) <= 300 THEN concat_ws(' ', a::VARCHAR, b::VARCHAR, c::VARCHAR) END AS scores,
         CASE WHEN length(text) <= 300 THEN CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END END::INTEGER AS pred
  FROM (SELECT *, {_LETTERS.format('[aeiou]')} AS a, {_LETTERS.format('[b-df-hj-np-tv-z]')} / 2 AS b,
               10 * {_LETTERS.format('[#*%&$]')} AS c FROM page_sents)""", "page_sents")

SQL["csv_articles_in_splits"] = "SELECT doc_id, source, text FROM documents"
SQL["stored_pages"] = with_views("SELECT article_id, html FROM page_html WHERE article_id % 2 = 0", "page_html")
SQL["registered_corpora"] = f"SELECT * FROM ({SQL['multitask_corpus']}) WHERE split IN ('train', 'test')"
SQL["vote_lists"] = with_views("""
  SELECT worker, (r // 64)::BIGINT AS chunk, string_agg(label::VARCHAR, ' ' ORDER BY r) AS labels
  FROM (SELECT worker, label, row_number() OVER (PARTITION BY worker ORDER BY event_id) - 1 AS r FROM votes)
  GROUP BY worker, r // 64""", "votes")

_SKIPPED = "script|style|noscript|template|head|svg|select|textarea"
_BLOCKS = ("address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|"
           "header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul")
_GAP = r"[ \t\n\r\f]"


def _solid_sql(x: str) -> str:
    return rf"length(regexp_replace({x}, '[ \t\n\r\f\x0B\x01\x02]+', '', 'g'))"


def _decoded_sql(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return strip_sql(f"translate({x}, '‘’“”', '''''\"\"')")


_UNLINKED = r"regexp_replace(x, '\x01[^\x02]*(\x02|$)', '', 'g')"
SQL["page_blocks"] = rf"""
  WITH marked AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      coalesce(html, ''), '[\x01-\x03]', '', 'g'),
      '(?is)<!--.*?-->|<({_SKIPPED})({_GAP}[^>]*)?>.*?</({_SKIPPED}){_GAP}*>', ' ', 'g'),
      '(?i)</?({_BLOCKS})({_GAP}[^>]*)?/?>', chr(3), 'g'), '(?is)<a({_GAP}[^>]*)?>', chr(1), 'g'),
      '(?i)</a{_GAP}*>', chr(2), 'g'), '<[^>]+>', '', 'g') AS m FROM pages),
  cut AS (SELECT page_id, unnest(string_split(m, chr(3))) AS x, generate_subscripts(string_split(m, chr(3)), 1) AS i FROM marked),
  texts AS (SELECT page_id, i, x, {_decoded_sql(r"regexp_replace(x, '[\x01\x02]', '', 'g')")} AS text FROM cut),
  sized AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS block_no, text,
                   len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS n_words,
                   CASE WHEN {_solid_sql('x')} > 0 THEN ({_solid_sql('x')} - {_solid_sql(_UNLINKED)}) / {_solid_sql('x')} ELSE 0 END AS link_share
            FROM texts WHERE text <> ''),
  judged AS (SELECT *, n_words >= 15 AND link_share <= 0.33 AS big FROM sized)
  SELECT page_id, block_no::INTEGER AS block_no, n_words::INTEGER AS n_words, round(link_share, 6) AS link_share, text,
         big OR (n_words >= 4 AND link_share <= 0.33 AND (coalesce(lag(big) OVER w, false) OR coalesce(lead(big) OVER w, false))) AS kept
  FROM judged WINDOW w AS (PARTITION BY page_id ORDER BY block_no)"""

cte("short_words", ("articles",), rf"""
  SELECT word, n_period, n_plain, score FROM (
    SELECT *, 2 * (k * ln(0.99::DOUBLE) + m * ln(1 - 0.99::DOUBLE) - k * ln(share) - m * ln(1 - share)) * exp(-size)
              * (length(word) - size + 1) * pow(size::DOUBLE, -m) AS score
    FROM (SELECT word, n_period, n_plain, n_period::DOUBLE AS k, n_plain::DOUBLE AS m, length(replace(word, '.', '')) AS size,
                 sum(n_period) OVER () / sum(n_period + n_plain) OVER () AS share
          FROM (SELECT word, sum(p)::BIGINT AS n_period, sum(1 - p)::BIGINT AS n_plain FROM (
                  SELECT regexp_replace(w, '[.]$', '') AS word, CASE WHEN w LIKE '%.' THEN 1 ELSE 0 END AS p FROM (
                    SELECT unnest(string_split_regex(lower(text), '{_GAP}+')) AS w FROM articles))
                WHERE regexp_matches(word, '^[a-z.]*[a-z][a-z.]*$') GROUP BY word))
    WHERE n_period > 0) WHERE score >= 0.01""")
cte("rule_pieces", ("articles",), rf"""
  SELECT paper_id, nth, piece, lower(regexp_extract(piece, '^([a-zA-Z]+)', 1)) AS first,
         regexp_replace(lower(regexp_extract(piece, '([^ \t\n\r\f]+)[.]$', 1)), '^[^a-z]+', '') AS last
  FROM (SELECT paper_id, unnest(s) AS piece, generate_subscripts(s, 1) AS nth FROM (
          SELECT paper_id, {split_sql('text')} AS s FROM articles))""")
cte("openers", ("rule_pieces", "short_words"), """
  SELECT word FROM (
    SELECT *, k1 / n1 AS p1, k2 / n2 AS p2, (k1 + k2) / (n1 + n2) AS p FROM (
      SELECT word, k1, k2, sum(k1) OVER () AS n1, sum(k2) OVER () AS n2 FROM (
        SELECT word, coalesce(s.n, 0)::DOUBLE AS k1, greatest(a.n - coalesce(s.n, 0), 0)::DOUBLE AS k2 FROM (
          SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM articles) GROUP BY word) a
        LEFT JOIN (SELECT first AS word, count(*) AS n FROM (
            SELECT first, lag(last) OVER (PARTITION BY paper_id ORDER BY nth) AS before FROM rule_pieces)
          WHERE first <> '' AND (before IS NULL OR before NOT IN (SELECT word FROM short_words)) GROUP BY first) s USING (word))))
  WHERE k1 > 0 AND p1 > p2 AND 2 * (
      k1 * ln(p1) + CASE WHEN n1 > k1 THEN (n1 - k1) * ln(1 - p1) ELSE 0 END
      + CASE WHEN k2 > 0 THEN k2 * ln(p2) ELSE 0 END + CASE WHEN n2 > k2 THEN (n2 - k2) * ln(1 - p2) ELSE 0 END
      - (k1 * ln(p) + CASE WHEN n1 > k1 THEN (n1 - k1) * ln(1 - p) ELSE 0 END)
      - (CASE WHEN k2 > 0 THEN k2 * ln(p) ELSE 0 END + CASE WHEN n2 > k2 THEN (n2 - k2) * ln(1 - p) ELSE 0 END)) >= 30""")
SQL["abbreviations"] = with_views("SELECT word, n_period, n_plain, round(score, 6) AS score FROM short_words", "short_words")
SQL["learned_sentences"] = with_views("""
  SELECT paper_id, sent_no::BIGINT AS sent_no, string_agg(piece, ' ' ORDER BY nth) AS text FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY paper_id ORDER BY nth) - 1 AS sent_no FROM (
      SELECT paper_id, nth, piece, CASE WHEN lag(w.word) OVER (PARTITION BY paper_id ORDER BY nth) IS NOT NULL AND o.word IS NULL
                                       THEN 0 ELSE 1 END AS fresh
      FROM rule_pieces p LEFT JOIN short_words w ON p.last = w.word LEFT JOIN openers o ON p.first = o.word))
  GROUP BY paper_id, sent_no""", "rule_pieces", "short_words", "openers")
