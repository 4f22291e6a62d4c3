import pyarrow as pa

from evoq.llm import word_bpe, words
from evoq.llm.queries import tokenizer_file


def test_ids_without_decoding(sidecars, words_of):
    """The pipeline wants no decoded texts: none are made or remembered, with whatever part of the memory."""
    model = tokenizer_file("word_bpe_49k.json")
    rows = [(i, " ".join(words_of(50 + i, i, 99999)) + " <|endoftext|> it's") for i in range(40)] + [(40, None), (41, "")]
    full = {r.key: (r.n_tokens, r.ids) for r in word_bpe.encode_texts(sidecars(rows), model).collect()}
    short = word_bpe.encode_texts(sidecars(rows), model, decoded=False, part=1e-6)
    assert short.columns == ["key", "n_tokens", "ids"] and {r.key: (r.n_tokens, r.ids) for r in short.collect()} == full
    encoder = word_bpe.WordEncoder(model, False)
    assert {e[2] for e in encoder.learn(["some", "wordless", "it's", "<|endoftext|>"]).values()} == {""}


def test_a_task_gives_memory_back():
    """After the last batch, or a task that ends early, Arrow's pool holds nothing of the task any more."""
    held = pa.total_allocated_bytes()

    def run(batches):
        kept = [pa.array(range(200_000)) for _ in batches]
        yield len(kept)
        yield 0

    task = words.giving_back(run)
    assert list(task(iter(range(5)))) == [5, 0] and pa.total_allocated_bytes() <= held
    started = task(iter(range(5)))
    assert next(started) == 5 and pa.total_allocated_bytes() > held
    started.close()
    assert pa.total_allocated_bytes() <= held
