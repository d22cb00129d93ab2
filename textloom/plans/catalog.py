"""Importing this module registers every query."""

from textloom.operators import answers, boundaries, chunking, concepts, enrichment, gaps, graphs, keyword_index, monitor, nested, networks, reports, retrieval, signals, texts, timelines, trials, tuning  # noqa: F401
from textloom.streaming import events, states  # noqa: F401
from textloom.sources import turtle  # noqa: F401
