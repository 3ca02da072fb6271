"""Imports every module that registers queries."""

from weftwork.plans import advice, binaries, code_quality, collide, graphs, joins, language_rules, line_diff, logs, mesh_cut, meshes, reports, rule_pack, rules, scalars, search, sources, states, streams, taint, texts, wordpiece  # noqa: F401
