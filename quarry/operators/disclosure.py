"""Sealed evidence: redaction that keeps the root, policies as columns over a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest
from .graph import within_hops


def redact(nodes: DataFrame, edges: DataFrame, cited: DataFrame, hops: int = 0) -> DataFrame:
    """(id, text, digest, withheld): what the claims cite, and what lies within some hops of it, stays readable.

    The digest is that of the full text for every node, so the manifest and its root don't change.
    """
    stays = within_hops(edges, cited, hops).select("id", F.lit(True).alias("stays"))
    marked = nodes.join(stays, "id", "left")
    hidden = F.col("stays").isNull()
    return marked.select("id", F.when(~hidden, F.col("text")).alias("text"), digest(F.col("text")).alias("digest"), hidden.alias("withheld"))


def _allowed(c: str, names) -> Column:
    return F.coalesce(F.col(c).isin(list(names)), F.lit(False))


#: Rules over a report with the columns named in them; a rule gives null where it holds, or else what is wrong. Those of a
#: group are written `group.rule`; a policy holds them as {group: {rule: ...}}.
RULES = {
    "require_signed": lambda want: F.when(F.lit(bool(want)) & F.col("signer").isNull(), "not signed"),
    "allowed_signers": lambda allowed: F.when(~_allowed("signer", allowed), "signer not allowed"),
    "require_rederived": lambda want: F.when(F.lit(bool(want)) & (F.col("status") != "RE-DERIVED"), "answer not re-derived"),
    "forbid_unverified_claims": lambda want: F.when(F.lit(bool(want)) & (F.col("unverified") > 0), "unverified claims"),
    "allowed_evidence_sources": lambda globs: F.when(~F.forall("sources", lambda s: _any_glob(s, globs)), "evidence source not allowed"),
    "actions.allow": lambda kinds: F.when(F.col("action").isNotNull() & ~_allowed("action", kinds), "action not allowed"),
    "actions.require_approval_gate": lambda want: F.when(F.lit(bool(want)) & F.col("action").isNotNull() & ~F.coalesce("gated", F.lit(False)), "action without an approval gate"),
    "actions.forbid_real_send": lambda want: F.when(F.lit(bool(want)) & F.coalesce("sent", F.lit(False)), "action really sent"),
    "chain.max_depth": lambda most: F.when(F.col("depth") > most, "chain too deep"),
    "chain.require_signed_upstreams": lambda want: F.when(F.lit(bool(want)) & F.exists("upstream_signers", lambda x: x.isNull()), "unsigned upstream"),
    "chain.allowed_upstream_signers": lambda names: F.when(F.exists("upstream_signers", lambda x: ~F.coalesce(x.isin(list(names)), F.lit(False))), "upstream signer not allowed"),
    "approvals.require": lambda least: F.when(F.size("approvers") < int(least), "too few approvals"),
    "approvals.allowed_approvers": lambda names: F.when(F.exists("approvers", lambda x: ~F.coalesce(x.isin(list(names)), F.lit(False))), "approver not allowed"),
    "approvals.distinct_approvers": lambda least: F.when(F.size(F.array_distinct("approvers")) < int(least), "too few approvers"),
    "redaction.allow": lambda may: F.when(F.lit(not may) & (F.col("withheld") > 0), "redaction not allowed"),
    "redaction.max_withheld": lambda most: F.when(F.col("withheld") > most, "too much withheld"),
    "ledger.require_inclusion": lambda want: F.when(F.lit(bool(want)) & ~F.coalesce("in_ledger", F.lit(False)), "not in the ledger"),
}


def glob_pattern(glob: str) -> str:
    """An anchored regular expression; * and ? also match slashes, case counts."""
    out = []
    for ch in glob:
        out.append(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() and ch not in "_" else ch)
    return "(?s)^" + "".join(out) + "$"


def _any_glob(c: Column, globs) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | c.rlike(glob_pattern(g))
    return out


def judge(reports: DataFrame, policy: dict) -> DataFrame:
    """(bundle_id, breaches): an unknown rule is refused, not skipped."""
    flat = {}
    for k, v in policy.items():
        flat |= {f"{k}.{rule}": x for rule, x in v.items()} if isinstance(v, dict) else {k: v}
    if unknown := sorted(set(flat) - set(RULES)):
        raise ValueError(f"unknown policy rule(s): {', '.join(unknown)}")
    return reports.select("bundle_id", F.array_compact(F.array(*(RULES[k](v) for k, v in flat.items()))).alias("breaches"))
