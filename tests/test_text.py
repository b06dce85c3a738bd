"""Text, label and risk columns against values worked out by hand."""

from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from mailscore.functions import labels, risk, segments
from mailscore.functions import mime
from mailscore.functions import text as tx
from mailscore.operators import scoring

PHISHING = (
    "Subject: Urgent Account Verification Required\n\nDear Customer,\n\n"
    "Your account has been temporarily suspended due to suspicious activity.\n"
    "To restore access, please verify your account immediately by clicking\nthe link below.\n\n"
    "https://secure-account-verification-login.example.com\n\n"
    "Failure to verify within 24 hours will result in permanent suspension.\n\nSecurity Team\n"
)


def one(spark, value, expression):
    """The expression over a single text."""
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def lowered(spark, value, expression):
    """The expression over the name of a column that holds the lower-cased text."""
    df = spark.createDataFrame([(value,)], "x string").withColumn("low", F.lower("x"))
    return df.select(expression("low").alias("y")).first().y


@pytest.mark.parametrize(
    "domain, trusted, value",
    [
        ("linkedin.com", True, 0.0),
        ("www.linkedin.com", True, 0.0),
        ("mail.linkedin.com", True, 0.0),
        ("phishing-linkedin.com", False, 0.1),
        ("linkedin.fake.com", False, 0.1),
        ("google.com", True, 0.0),
        ("suspicious-site.xyz", False, 0.6),
        ("unknown", False, 0.3),
        ("phishing-bank.com", False, 0.8),
        ("", False, 0.3),
        (None, False, 0.3),
        ("LinkedIn.COM", True, 0.0),
    ],
)
def test_domain_trust_and_risk(spark, domain, trusted, value):
    assert lowered(spark, domain, risk.is_trusted) is trusted
    assert lowered(spark, domain, risk.domain_risk) == value


@pytest.mark.parametrize(
    "links, n, trusted, value",
    [(10, 10, 10, 0.1), (3, 3, 2, 0.3), (5, 2, 0, 0.6), (10, 0, 0, 0.8), (0, 0, 0, 0.0), (1, 1, 0, 0.2), (2, 5, 4, 0.1), (6, 2, 1, 0.3)],
)
def test_links_risk(spark, links, n, trusted, value):
    df = spark.createDataFrame([(links, n, trusted)], "l int, n int, t int")
    assert df.select(risk.links_risk(F.col("l"), risk.trusted_share(F.col("n"), F.col("t"))).alias("r")).first().r == value


@pytest.mark.parametrize(
    "score, name", [(0.0, "LEGITIMATE"), (0.5999, "LEGITIMATE"), (0.6, "SUSPICIOUS"), (0.7999, "SUSPICIOUS"), (0.8, "PHISHING"), (1.0, "PHISHING")]
)
def test_verdict_on_cut_points(spark, score, name):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(risk.verdict(F.col("s"), 0.6, 0.2).alias("v")).first().v == name


def test_trust_lowers_score(spark):
    rows = [(True, True, 0.6), (True, False, 0.8), (False, True, 0.8), (False, False, 1.0)]
    for sender, links, factor in rows:
        df = spark.createDataFrame([(sender, links)], "s boolean, l boolean")
        assert df.select(risk.trust_factor(F.col("s"), F.col("l")).alias("f")).first().f == factor


def test_html_and_white_space(spark):
    html = "<!DOCTYPE html><p>a&nbsp;b</p><script>x('<p>')</script><style>p{}</style><!-- no -->c&#233;&#x1F600; &amp;lt;"
    assert one(spark, html, tx.normalize_text) == "a b cé😀 &lt;"
    assert one(spark, "1 < 2 & 3", tx.strip_html) == "1 < 2 & 3"
    assert one(spark, None, tx.normalize_text) == ""
    assert one(spark, " a  b\x00\x1cc\t\n ", tx.normalize_text) == "a b c"
    assert one(spark, "　 x y \x85", tx.ws_trim) == "x y"


class _Text(HTMLParser):
    """Text nodes outside of scripts and styles."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.found, self.silent = [], None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.silent = tag if tag in ("script", "style") else self.silent

    def handle_endtag(self, tag):
        self.silent = None if tag == self.silent else self.silent

    def handle_data(self, data):
        if self.silent is None:
            self.found.append(data)


def test_expressions_agree_with_a_parser(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html", tx.normalize_text(F.col("html")).alias("text")).collect()
    assert rows
    for row in rows:
        words = " ".join(_Text(row.html).found) if "<" in row.html and ">" in row.html else row.html
        assert row.text.split() == words.split()


def test_references_of_any_name(spark):
    names = [n for n in html5 if n.endswith(";")]
    got = one(spark, "".join(f"[&{n}]" for n in names), tx.decode_references)
    assert got == "".join(f"[{html5[n]}]" for n in names)
    numbers = "&#233;|&#xE9;|&#146;|&#x92;|&#38;lt;|&#0;|&#xD800;|&#99999999;|&#x110000;|&nosuch;|&lt|&;|&"
    assert one(spark, numbers, tx.decode_references) == "é|é|’|’|&lt;|&#0;|&#xD800;|&#99999999;|&#x110000;|&nosuch;|&lt|&;|&"
    assert one(spark, "<p>Vi&ecirc;t&nbsp;&agrave; &sum;", tx.normalize_text) == "Viêt à ∑"
    assert one(spark, None, tx.decode_references) is None


def test_parts_that_are_never_closed(spark):
    for html in ("<p>x<script>var a = '<b>'", "<p>x<style>p {}\n", "<p>x<!-- to <b>the</b> end", "<script>a</script><p>x<SCRIPT src=a>b\n"):
        assert one(spark, html, tx.normalize_text) == "x"


def test_links_and_addresses(spark):
    text = "See HTTPS://Up.com and www.Google.com/x http://a.b:80/q http://a.b?z."
    assert one(spark, text, lambda x: tx.url_count(tx.urls(x))) == 4
    assert one(spark, text, lambda x: tx.link_domains(tx.urls(x))) == ["https", "google.com", "a.b"]
    assert one(spark, text, lambda x: tx.link_domains(tx.urls(x), True)) == ["up.com", "google.com", "a.b"]
    assert one(spark, None, lambda x: tx.url_count(tx.urls(x))) == 0
    assert one(spark, "no link", lambda x: tx.has_url(tx.urls(x))) == 0
    assert one(spark, "to é.x@Mail.Example.COM, b@c.de", tx.sender_domain) == "mail.example.com"
    assert one(spark, "nobody", tx.sender_domain) == "unknown"
    assert one(spark, None, tx.sender_domain) == "unknown"


def test_keywords(spark):
    assert lowered(spark, "asterisk", tx.urgent_flag) == 1  # risk, inside a word
    assert lowered(spark, "verify verify important", tx.urgent_count) == 2
    assert lowered(spark, "report.docx", tx.attachment_flag) == 1
    assert lowered(spark, None, tx.attachment_flag) == 0
    assert one(spark, "a!b!!", tx.exclamation_count) == 3
    assert one(spark, "é😀", tx.char_count) == 2


@pytest.mark.parametrize(
    "value, known, lenient",
    [
        (" Phishing ", 1, 1), ("scam", 1, 0), ("1.0", 1, 1), ("HAM", 0, 0), ("no", 0, 0), ("2", None, 1),
        ("0.5", None, 0), ("-3", None, 1), ("1f", None, 0), ("nan", None, 0), (None, None, 0), ("x", None, 0),
    ],
)
def test_labels(spark, value, known, lenient):
    assert one(spark, value, labels.known_label) == known
    assert one(spark, value, labels.lenient_label) == lenient


def test_strict_label_fails(spark):
    assert one(spark, "spam", labels.strict_label) == 1
    for bad in ("2", None):
        with pytest.raises(Exception, match="unknown label"):
            one(spark, bad, labels.strict_label)


def test_sample_email(spark):
    df = spark.createDataFrame([(1, PHISHING, 0.9)], "email_id int, text string, probability double")
    r = scoring.score_emails(df, threshold=0.6).first()
    assert (r.links_count, r.link_domains) == (1, ["secure-account-verification-login.example.com"])
    assert (r.sender_domain, r.urgent_keywords, r.has_attachment, r.exclamation_count) == ("unknown", 1, 0, 0)
    assert (r.links_risk, r.domain_risk, r.trust_factor) == (0.2, 0.3, 1.0)
    assert r.ensemble_score == pytest.approx(0.6 * 0.9 + 0.21)
    assert (r.classification, r.prediction, r.is_suspicious) == ("SUSPICIOUS", 1, True)
    assert lowered(spark, PHISHING, lambda x: tx.contained_words(x, ["urgent", "immediately", "asap", "24 hours"])) == [
        "urgent", "immediately", "24 hours",
    ]
    top = scoring.suspicious_segments(df).orderBy("rank").collect()
    assert [x.score for x in top][:3] == [75.0, 75.0, 60.0] and len(top) == 6
    assert top[0].severity == "HIGH"


def test_segments_of_quiet_text_are_none(spark):
    df = spark.createDataFrame([(1, "Nothing to see here at all.\nA second line of words."), (2, None)], "email_id int, text string")
    assert scoring.suspicious_segments(df).count() == 0
    assert scoring.all_segments(df).count() == 2


def test_segment_cut_order_and_reasons(spark):
    long = "click here for your prize " + "x" * 200
    text = f"{long}\nhttps://example-site.org\nplease verify your account now"
    rows = scoring.suspicious_segments(spark.createDataFrame([(1, text)], "email_id int, text string")).orderBy("rank").collect()
    assert [r.score for r in rows] == [45.0, 30.0, 20.0]
    assert rows[1].segment == long[:150] + "..." and rows[1].reasons == ["Yêu cầu click", "Hứa hẹn phần thưởng"]
    assert rows[0].reasons == ["Từ khóa khẩn cấp: verify", "Yêu cầu xác minh"]
    assert rows[2].reasons == ["Chứa 1 link"] and rows[2].severity == "LOW"


def test_top_ten_keeps_text_order(spark):
    text = "\n".join(f"please verify number {i:02d}" for i in range(15))
    rows = scoring.suspicious_segments(spark.createDataFrame([(1, text)], "email_id int, text string")).collect()
    assert sorted(r.position for r in rows) == list(range(10))


def test_compat_defaults(spark):
    df = spark.createDataFrame([(1, "see attached!")], "email_id int, text string")
    r = scoring.extract_features(df, compat_serving_defaults=True).first()
    assert (r.has_attachment, r.body_length, r.exclamation_count) == (0, 0, 0)
    assert scoring.extract_features(df).first().has_attachment == 1


def test_clues_cover_every_pattern(spark):
    words = [["click now"], ["verify your"], ["credit card"], ["expired"], ["gift"], ["$5"]]
    for i, (text,) in enumerate(words):
        df = spark.createDataFrame([(text,)], "x string").select(*[v.alias(k) for k, v in segments.clues("x").items()])
        assert df.first()[f"pattern{i}"] is True


def test_genuine_replacement_characters_stay(spark):
    rows = spark.createDataFrame([("a�b".encode(),), (b"a\xffb",), (b"",), (None,)], "raw binary")
    assert [r.t for r in rows.select(mime.valid_text(F.col("raw")).alias("t")).collect()] == ["a�b", "ab", "", None]
