"""Registered queries; each module has QUERIES and ORACLES."""

from itemforge.plans import extra, matching, parsing, store, wide

PLANS = [matching, store, parsing, extra, wide]
