"""File loaders: delimiter detection, line-number ids, dispatch and errors."""

import pytest

from glosspark.sources.loaders import load_dataset


def _write(p, lines):
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


def test_signum_parallel(spark, tmp_path):
    g = _write(tmp_path / "g.txt", ["# comment", "", "a1\tX-WE GO", "a2|HOUSE X-POSS", "a3::TREE", "noid", "a4\t"])
    t = _write(tmp_path / "t.txt", ["a1\twe go", "a2 | the house's", "a3::tree", "a4\tfour"])
    got = sorted(tuple(r) for r in load_dataset(spark, "signum", anno_path=g, trans_path=t).collect())
    assert got == [("a1", "X-WE GO", "we go"), ("a2", "HOUSE X-POSS", "the house's"), ("a3", "TREE", "tree")]


def test_phoenix_splits_skip_missing(spark, tmp_path):
    tr = _write(tmp_path / "train.gloss", ["A B|a b|x", "", "C|c", "D|d|y|z"])
    got = load_dataset(spark, "phoenix", train_path=tr, dev_path=str(tmp_path / "none"),
                       test_path=str(tmp_path / "none2")).collect()
    assert sorted((r.id, r.gloss, r.translation, r.split) for r in got) == [
        ("train_000000", "A B", "a b", "train"), ("train_000003", "D", "d", "train")]


def test_aslg_line_ids_and_combined(spark, tmp_path):
    g = _write(tmp_path / "g.txt", ["X-I GO", "", "HOME"])
    t = _write(tmp_path / "t.txt", ["i go", "", "home"])
    got = sorted(tuple(r) for r in load_dataset(spark, "aslg", gloss_path=g, text_path=t).collect())
    assert got == [("aslg_000000", "X-I GO", "i go"), ("aslg_000002", "HOME", "home")]
    c = _write(tmp_path / "c.txt", ["i go\tX-I GO", "no tab", "home\tHOME"])
    got = sorted(tuple(r) for r in load_dataset(spark, "aslg", gloss_path="/nope", text_path="/nope",
                                                  combined_path=c).collect())
    assert got == [("aslg_000000", "i go", "X-I GO"), ("aslg_000002", "home", "HOME")]
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, "aslg", gloss_path="/nope", text_path="/nope", combined_path="/nope")
    with pytest.raises(ValueError):
        load_dataset(spark, "other")


def test_paths_with_a_scheme_load_the_same(spark, tmp_path):
    from glosspark.sources.loaders import load_pipe_splits
    paths = {}
    for s in ("train", "dev"):
        (tmp_path / s).write_text("A B|a b|x\nC|c|y\n", encoding="utf-8")
        paths[s] = str(tmp_path / s)
    paths["test"] = str(tmp_path / "absent")
    assert load_pipe_splits(spark, paths).count() == 4
    assert load_pipe_splits(spark, {k: f"file://{v}" for k, v in paths.items()}).count() == 4


def test_a_folder_of_files_is_refused(spark, tmp_path):
    import pytest
    from glosspark.sources.lines import read_lines
    for n in "ab":
        (tmp_path / n).write_text("x\n")
    with pytest.raises(ValueError):
        read_lines(spark, str(tmp_path))
