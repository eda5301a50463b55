"""The operations that users call by name: functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from quillmark.operators import analysis, canonical, changes, dedup, evaluation, feedback, lexicon, mail, matching, merge, report, retrieval, retry, routing

TOOLS: dict[str, Callable[..., DataFrame]] = {
    "canonical_bulletin": canonical.from_bulletin, "canonical_feed": canonical.from_rss, "keep_bulletin": canonical.keep_bulletin, "keep_feed": canonical.keep_rss, "flatten": canonical.flatten, "dedup_keys": canonical.dedup_keys,
    "match": dedup.match, "already_analysed": dedup.already_analysed, "to_analyse": dedup.to_analyse, "latest": dedup.latest,
    "originals": changes.originals, "amendments": changes.amendment_view, "amend": changes.with_history, "apply_minor": changes.apply_minor, "original_by_title": changes.by_title, "contained": matching.contained, "overlapping": matching.overlapping, "prequalified": canonical.prequalified,
    "score": lexicon.score, "category_of_term": lexicon.category_of_term, "term_summary": lexicon.term_summary, "nearest": retrieval.nearest, "known_buyer": retrieval.known_buyer,
    "analyse": routing.analyse, "finish": routing.finish, "price_skipped": routing.price_skipped, "keep_minor": routing.keep_minor, "second_gate": analysis.second_gate, "verify_conditions": analysis.verify_conditions, "embed": analysis.embed,
    "active_rules": feedback.active_rules, "duplicate_rules": feedback.duplicates, "duplicate_chunks": feedback.duplicate_chunks, "similar_rules": feedback.similar_rules, "impact": feedback.impact, "simulate": feedback.simulate, "history": feedback.history, "details": feedback.details, "enrich": feedback.enrich, "deactivate_rule": feedback.deactivate, "revert_manual": feedback.revert_manual,
    "report_totals": report.totals, "by_source": report.by_source, "daily": report.daily, "completeness": report.completeness, "completeness_by": report.completeness_by, "by_day": report.by_day, "lists_by_source": mail.lists_by_source, "text_mail": mail.text_mail, "html_mail": mail.html_mail, "assemble_mail": mail.assemble, "mail_mode": report.mail_mode, "text_summary": report.text_summary, "ranked": report.ranked,
    "accuracy": evaluation.accuracy, "compare_models": evaluation.compare_models, "stratified": evaluation.stratified,
    "upsert": merge.upsert, "update": merge.update, "cancel": merge.cancel, "delete": merge.delete, "insert_new": merge.insert_new, "violations": merge.violations,
    "schedule_retry": retry.schedule, "ready_retries": retry.ready, "settle_retries": retry.settle, "retain_retries": retry.retain,
}


def call(name: str, *frames: DataFrame, **options: Any) -> DataFrame:
    """The result of the operation of that name; an unknown name is an error that lists the known ones."""
    if name not in TOOLS:
        raise KeyError(f"no operation {name}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](*frames, **options)
