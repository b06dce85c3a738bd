"""SQL for checking the registered queries on another engine.

Each check is a SELECT that names the derived tables it needs; they become a
leading WITH in order of dependence.
"""

from __future__ import annotations

import re

from mailscore import constants as c
from mailscore.sources import fixtures


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def list_of(words: list[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def trusted(d: str) -> str:
    below = " OR ".join(f"ends_with({d}, {quoted('.' + t)})" for t in c.TRUSTED_DOMAINS)
    return f"({d} IN {in_list(c.TRUSTED_DOMAINS)} OR {below})"


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def count_of(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, {quoted(w)})::INT" for w in words) + ")"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^[{c.WS}]+|[{c.WS}]+$')}, '', 'g')"


def portable(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{c.WS}]").replace(r"\d", r"\p{Nd}")


def html_text(x: str) -> str:
    bare = x
    for pattern in c.HTML_DROP_RES:
        bare = f"regexp_replace({bare}, {quoted(pattern)}, ' ', 'g')"
    for name, char in c.HTML_ENTITIES:
        bare = f"replace({bare}, {quoted(name)}, {quoted(char)})"
    return f"CASE WHEN {x} IS NULL THEN '' WHEN contains({x}, '<') AND contains({x}, '>') THEN {bare} ELSE {x} END"


def normal_text(x: str) -> str:
    return f"trim(regexp_replace(replace({html_text(x)}, chr(0), ' '), {quoted(f'[{c.WS}]+')}, ' ', 'g'))"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def domain_risk(d: str) -> str:
    part = any_of(d, c.SUSPICIOUS_DOMAIN_PARTS)
    tld = " OR ".join(f"ends_with({d}, {quoted(t)})" for t in c.SUSPICIOUS_TLDS)
    return (
        f"CASE WHEN {d} IS NULL OR {d} IN ('', 'unknown') THEN 0.3::DOUBLE WHEN {trusted(d)} THEN 0.0::DOUBLE "
        f"WHEN {part} THEN 0.8::DOUBLE WHEN {tld} THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END"
    )


LINKS_RISK = (
    "CASE WHEN share >= 0.8 THEN 0.1::DOUBLE WHEN share >= 0.5 THEN 0.3::DOUBLE WHEN links_count = 0 THEN 0.0::DOUBLE "
    "WHEN links_count = 1 THEN 0.2::DOUBLE WHEN links_count <= 3 THEN 0.4::DOUBLE "
    "WHEN links_count <= 5 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END"
)
BUCKET = (
    "CASE WHEN n <= 0 THEN NULL WHEN n <= 100 THEN '<100' WHEN n <= 500 THEN '100-500' WHEN n <= 1000 THEN '500-1K' "
    "WHEN n <= 2000 THEN '1K-2K' WHEN n <= 5000 THEN '2K-5K' WHEN n <= 10000 THEN '5K-10K' "
    "WHEN n <= 50000 THEN '10K-50K' WHEN n IS NOT NULL THEN '>50K' END"
)

_TABLES = {"{documents}": "documents", "{labels}": "labels", "{events}": "events"}


def _plain(sql: str) -> str:
    for slot, name in _TABLES.items():
        sql = sql.replace(slot, name)
    return sql


def _segment_score() -> str:
    matched = " + ".join(
        f"CASE WHEN regexp_matches(ls, {quoted(portable(p))}) THEN 0.15::DOUBLE ELSE 0 END" for p, _ in c.SEGMENT_PATTERNS
    )
    return f"least(0.3::DOUBLE * least(nk, 3) + 0.2::DOUBLE * least(nl, 2) + {matched}, 1.0)"


def _segment_reasons() -> str:
    before, after = c.SEGMENT_LINK_REASON
    parts = [
        f"CASE WHEN nk > 0 THEN {quoted(c.SEGMENT_KEYWORD_REASON)} || array_to_string(kw[1:3], ', ') END",
        f"CASE WHEN nl > 0 THEN {quoted(before)} || nl || {quoted(after)} END",
    ] + [f"CASE WHEN regexp_matches(ls, {quoted(portable(p))}) THEN {quoted(r)} END" for p, r in c.SEGMENT_PATTERNS]
    return "concat_ws(' | ', " + ", ".join(parts) + ")"


# name → (tables it needs, SELECT)
CTES: dict[str, tuple[list[str], str]] = {
    "emails": ([], _plain(fixtures.EMAILS_SQL)),
    "predictions": ([], _plain(fixtures.PREDICTIONS_SQL)),
    "raw_labels": ([], _plain(fixtures.RAW_LABELS_SQL)),
    "received": (["emails"], "SELECT *, TIMESTAMP '2024-01-01' + to_minutes(email_id::BIGINT) AS received_at FROM emails"),
    "latest": (
        ["predictions"],
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
        "(PARTITION BY email_id ORDER BY created_at DESC, prediction_id DESC) AS rn FROM predictions) WHERE rn = 1",
    ),
    "texts": (
        ["emails"],
        "SELECT *, CASE WHEN length(subject) > 0 THEN concat(subject, ' ', body) ELSE body END AS text FROM emails",
    ),
    "found": (
        ["texts"],
        f"""SELECT *, lower(text) AS lt, regexp_extract_all(text, {quoted(c.URL_RE)}) AS urls,
          coalesce(nullif(lower(regexp_extract(text, {quoted(c.ADDRESS_RE)}, 1)), ''), 'unknown') AS sender_domain
        FROM texts""",
    ),
    "domains": (
        ["found"],
        f"""SELECT *, list_filter(ds, lambda d, i: list_position(ds, d) = i) AS link_domains FROM (
          SELECT *, list_filter(list_transform(urls, lambda u:
            split_part(lower(regexp_extract(u, {quoted(c.LINK_DOMAIN_RE)}, 1)), ':', 1)), lambda d: d <> '') AS ds
          FROM found)""",
    ),
    "feat": (
        ["domains"],
        f"""SELECT email_id, user_id, label, subject, sender, body, text, lt, sender_domain, urls, link_domains,
          len(urls)::INT AS links_count,
          {any_of('lt', c.URGENT_KEYWORDS)}::INT AS urgent_keywords,
          {count_of('lt', c.URGENT_KEYWORDS)}::INT AS urgent_count,
          {any_of('lt', c.ATTACHMENT_KEYWORDS)}::INT AS has_attachment,
          length(text)::INT AS body_length,
          (length(text) - length(replace(text, '!', '')))::INT AS exclamation_count,
          len(link_domains)::INT AS n_domains,
          len(list_filter(link_domains, lambda d: {trusted('d')}))::INT AS n_trusted
        FROM domains""",
    ),
    "risks": (
        ["feat", "latest"],
        f"""SELECT *, p * 0.6::DOUBLE + urgent_keywords * 0.15::DOUBLE + links_risk * 0.15::DOUBLE + domain_risk * 0.1::DOUBLE AS base_score,
          CASE WHEN sender_trusted AND links_trusted THEN 0.6::DOUBLE WHEN sender_trusted OR links_trusted THEN 0.8::DOUBLE
            ELSE 1.0::DOUBLE END AS trust_factor FROM (
          SELECT *, {LINKS_RISK} AS links_risk, {domain_risk('sender_domain')} AS domain_risk,
            {trusted('sender_domain')} AS sender_trusted, coalesce(share >= 0.8, false) AS links_trusted
          FROM (SELECT f.*, l.probability AS p, n_trusted::DOUBLE / nullif(n_domains, 0) AS share
                FROM feat f LEFT JOIN latest l USING (email_id)))""",
    ),
    "scored": (
        ["risks"],
        """SELECT *, CASE WHEN score IS NULL THEN 'NOT_SCORED' WHEN score < 0.5 THEN 'LEGITIMATE' WHEN score < 0.5::DOUBLE + 0.2::DOUBLE THEN 'SUSPICIOUS'
            ELSE 'PHISHING' END AS classification
          FROM (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(0.0, least(1.0, base_score * trust_factor)) END AS score FROM risks)""",
    ),
    "segs": (
        ["emails"],
        f"""SELECT email_id, unnest(l) AS segment, unnest(range(len(l))) AS position FROM (
          SELECT email_id, list_filter(list_transform(string_split_regex(body, '[.\\n\\r]+'),
            lambda s: {trim_ws('s')}), lambda s: length(s) > 10) AS l FROM emails)""",
    ),
    "seg_facts": (
        ["segs"],
        f"""SELECT *, len(kw) AS nk FROM (
          SELECT *, lower(segment) AS ls, len(regexp_extract_all(segment, {quoted(c.URL_RE)})) AS nl,
            list_filter({list_of(c.URGENT_KEYWORDS)}, lambda k: contains(lower(segment), k)) AS kw FROM segs)""",
    ),
    "seg_scored": (
        ["seg_facts"],
        f"""SELECT *, round(risk * 100, 1) AS score FROM (
          SELECT *, {_segment_score()} AS risk, {_segment_reasons()} AS reasons FROM seg_facts)
          WHERE risk >= 0.2 OR nk > 0 OR nl > 0""",
    ),
    "seg_top": (
        ["seg_scored"],
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY score DESC, position) AS rank
          FROM seg_scored) WHERE rank <= 10""",
    ),
    "lens": (["emails"], "SELECT email_id, label, length(body) AS n FROM emails"),
    "buckets": (["lens"], f"SELECT *, {BUCKET} AS bucket FROM lens"),
    "doc_words": (
        [],
        f"""SELECT doc_id, list_filter(regexp_extract_all(lower(text), {quoted(c.TOKEN_RE)}),
            lambda w: w NOT IN {in_list(c.STOP_WORDS)}) AS w FROM documents""",
    ),
    "doc_terms": (
        ["doc_words"],
        """SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(w,
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM doc_words)
            GROUP BY doc_id, term""",
    ),
    "mail_words": (
        ["emails"],
        f"""SELECT email_id, label, list_filter(regexp_extract_all(lower(body), {quoted(c.TOKEN_RE)}),
            lambda w: w NOT IN {in_list(c.STOP_WORDS)}) AS w FROM emails WHERE label IS NOT NULL""",
    ),
    "mail_terms": (
        ["mail_words"],
        """SELECT email_id, label, term, count(*) AS tf FROM (SELECT email_id, label, unnest(list_concat(w,
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM mail_words)
            GROUP BY email_id, label, term""",
    ),
    "vocab": (
        ["mail_terms"],
        f"""SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df,
            ln((1 + (SELECT count(*) FROM mail_words))::DOUBLE / (1 + count(*))) + 1 AS idf
          FROM mail_terms GROUP BY term ORDER BY cf DESC, term LIMIT {c.VOCABULARY_SIZE}""",
    ),
    "weights": (
        ["mail_terms", "vocab"],
        """SELECT email_id, label, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY email_id)) AS w
          FROM mail_terms JOIN vocab USING (term)""",
    ),
    "term_diff": (
        ["weights", "vocab"],
        """SELECT v.term, coalesce(sum(w) FILTER (label = 1), 0) / (SELECT count(*) FROM mail_words WHERE label = 1) AS phishing,
            coalesce(sum(w) FILTER (label = 0), 0) / (SELECT count(*) FROM mail_words WHERE label = 0) AS legitimate
          FROM vocab v LEFT JOIN weights x ON v.term = x.term GROUP BY v.term""",
    ),
}


def build(select: str, *needs: str) -> str:
    """The SELECT with a WITH for the tables it needs, by name or by mention."""
    mentioned = [n for n in CTES if re.search(rf"\b{n}\b", select)]
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        for before in CTES[name][0]:
            add(before)
        done[name] = CTES[name][1]

    for name in [*needs, *mentioned]:
        add(name)
    if not done:
        return select.strip()
    return "WITH " + ",\n".join(f"{n} AS ({sql.strip()})" for n, sql in done.items()) + "\n" + select.strip()


class Registry:
    """Queries by name, with the SQL that checks them where there is one."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = build(sql)
            return fn

        return keep
