"""Rule risks, the ensemble score and the verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailscore import constants as c
from mailscore.functions.text import sql_text


def _trusted_sql(domain: str, trusted: list[str] | None) -> str:
    names = c.TRUSTED_DOMAINS if trusted is None else trusted
    d = f"lower({domain})"
    listed = ", ".join(sql_text(t) for t in names)
    below = " OR ".join(f"endswith({d}, {sql_text('.' + t)})" for t in names)
    return f"coalesce({d} IN ({listed}) OR {below}, false)"


def is_trusted(domain: str, trusted: list[str] | None = None) -> Column:
    """The domain in the named column is on the list or below a domain that is."""
    return F.expr(_trusted_sql(domain, trusted))


def trusted_count(domains: str, trusted: list[str] | None = None) -> Column:
    """Number of trusted domains in the named array column."""
    return F.expr(f"size(filter({domains}, d -> {_trusted_sql('d', trusted)}))")


def domain_risk(domain: str, trusted: Column | None = None) -> Column:
    """Risk of a sender domain; ``trusted`` is its flag where already at hand."""
    d = f"lower({domain})"
    part = F.expr(" OR ".join(f"contains({d}, {sql_text(p)})" for p in c.SUSPICIOUS_DOMAIN_PARTS))
    tld = F.expr(" OR ".join(f"endswith({d}, {sql_text(t)})" for t in c.SUSPICIOUS_TLDS))
    return (
        F.when(F.expr(f"coalesce({domain}, '') IN ('', 'unknown')"), F.lit(c.DOMAIN_RISK_UNKNOWN))
        .when(is_trusted(domain) if trusted is None else trusted, F.lit(c.DOMAIN_RISK_TRUSTED))
        .when(part, F.lit(c.DOMAIN_RISK_PART))
        .when(tld, F.lit(c.DOMAIN_RISK_TLD))
        .otherwise(F.lit(c.DOMAIN_RISK_OTHER))
    )


def trusted_share(n_domains: Column, n_trusted: Column) -> Column:
    """Share of trusted link domains; null where there is no link domain."""
    return n_trusted / F.nullif(n_domains, F.lit(0))


def links_trusted(share: Column) -> Column:
    return F.coalesce(share >= c.LINKS_TRUSTED_SHARE, F.lit(False))


def links_risk(links: Column, share: Column) -> Column:
    """Risk of the links: a trusted majority decides first, else their number."""
    risk = F
    for least, value in c.LINK_SHARE_RISKS:
        risk = risk.when(share >= least, F.lit(value))
    for most, value in c.LINK_COUNT_RISKS:
        risk = risk.when(links <= most, F.lit(value))
    return risk.otherwise(F.lit(c.LINK_COUNT_RISK_MORE))


def base_score(p: Column, urgent: Column, links_r: Column, domain_r: Column) -> Column:
    return (
        p * F.lit(c.WEIGHT_MODEL)
        + urgent.cast("double") * F.lit(c.WEIGHT_URGENT)
        + links_r * F.lit(c.WEIGHT_LINKS)
        + domain_r * F.lit(c.WEIGHT_DOMAIN)
    )


def trust_factor(sender: Column, links: Column) -> Column:
    return (
        F.when(sender & links, F.lit(c.FACTOR_BOTH_TRUSTED))
        .when(sender | links, F.lit(c.FACTOR_ONE_TRUSTED))
        .otherwise(F.lit(1.0))
    )


def clamp01(x: Column) -> Column:
    """Limited to 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def verdict(score: Column, threshold: float = c.DEFAULT_THRESHOLD, margin: float = c.SUSPICIOUS_MARGIN) -> Column:
    """Three levels; a score on a cut point belongs to the level above it. No score is a level of its own."""
    return (
        F.when(score.isNull(), F.lit(c.NOT_SCORED))
        .when(score < F.lit(threshold), F.lit(c.LEGITIMATE))
        .when(score < F.lit(threshold) + F.lit(margin), F.lit(c.SUSPICIOUS))
        .otherwise(F.lit(c.PHISHING))
    )


def prediction(classification: Column) -> Column:
    """1 for the upper two levels, 0 for the lowest, null where there is no score."""
    return F.when(classification != c.NOT_SCORED, (classification != c.LEGITIMATE).cast("int"))


def round6(x: Column) -> Column:
    """Rounded to six places, with no negative zero."""
    return F.round(x, c.SCORE_DECIMALS) + F.lit(0.0)
