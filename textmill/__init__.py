"""Analytics over language-model text corpora, as Spark DataFrame operators."""
