"""Small corpora with the awkward rows every operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, texts, extra=False):
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumnsRenamed({"source": "items"}) if extra else df


AWKWARD = [None, "", "   \n\t ", "one", "one two three", "One TWO three", "é" * 50, "日本語 の 文", "<|im_end|><|endoftext|>",
           "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "word " * 3000, "x" * 20000]
