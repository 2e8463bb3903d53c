"""Cloze and priming experiments on language-model scores, as Spark DataFrame operators."""
