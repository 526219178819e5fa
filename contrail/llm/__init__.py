"""Operators for preparing large text corpora for training: near duplicates, decontamination, token
counts, secrets, language, toxicity, line quality and language-model scores.

Nothing outside this subpackage imports it. Each module holds one operator with its own general
interface; ``queries.py`` registers the thin ``opN_<name>`` queries and their SQL.
"""
