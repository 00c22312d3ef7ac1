"""Timeloom: evidence timelines as Spark DataFrames."""

from timeloom.plans.case import Case, EvidenceInput, analyze, case_from_events
from timeloom.session import prepare, release

__all__ = ["Case", "EvidenceInput", "analyze", "case_from_events", "prepare", "release"]
