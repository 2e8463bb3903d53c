"""Readers and writers: stimuli, lexicon, sentence corpus, result files with provenance."""
from clozeframe.sources.provenance import parse_provenance
from clozeframe.sources.readers import (
    read_contexts,
    read_csv,
    read_fix_results,
    read_legacy_stimuli,
    read_lexicon,
    read_results,
    read_sentences,
    read_stimuli,
    sentences_from_text,
    union_files,
)
from clozeframe.sources.writers import write_table

__all__ = [
    "parse_provenance",
    "read_contexts",
    "read_csv",
    "read_fix_results",
    "read_legacy_stimuli",
    "read_lexicon",
    "read_results",
    "read_sentences",
    "read_stimuli",
    "sentences_from_text",
    "union_files",
    "write_table",
]
