"""Parsing, site model, rules, policy, reports and diffs."""
