"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""
from strandframe.llm import decontaminate, jaccard_join, mixing, token_store, toxicity
from strandframe.llm._shared import materialize, table


def remove_toxic(spark, docs, sf_dir):
    """Rows judged toxic by their own text go; null and empty texts stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_copies(spark, docs, sf_dir):
    """One row of each group of near copies stays (five words, 0.8); rows without words all stay."""
    return jaccard_join.keep_one(docs, n=5, num=80, den=100)


def decontaminated(spark, docs, sf_dir):
    """Benchmark passages are cut out; a row mostly made of them goes; other texts stay as they are."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Whole documents, each as often as the mix takes its words; rows without words stay once."""
    return mixing.repeat_taken(docs)


def tokens(spark, docs, sf_dir):
    """Per document what its shard holds: start, n_tokens, checksum; nulls are empty texts."""
    return token_store.token_output(spark, docs)


STAGES = [("toxicity", remove_toxic), ("near_copies", remove_near_copies), ("decontamination", decontaminated), ("mixing", mixed), ("tokens", tokens)]
ORACLE_SQL = None  # a trained classifier and a tokenizer are not SQL


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
