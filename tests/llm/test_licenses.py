import re

from urbanloom.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in lic.PHRASES.items():
        seq = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(seq)] == seq]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_automaton():
    a = lic.Automaton("alpha <<optional>>beta <<any:0-2>><<end>> gamma <<any:1-2>> delta")
    ok = ["alpha gamma x delta", "alpha beta gamma x y delta", "q alpha beta x y gamma x delta z"]
    no = ["alpha gamma delta", "alpha beta x y z gamma x delta", "alpha gamm x delta", "alpha gamma x y z delta", ""]
    assert all(a.found(t.encode().split()) for t in ok)
    assert not any(a.found(t.encode().split()) for t in no)


def test_templates_accept_their_wording():
    text = "Licensed under the Apache License, Version 2.0."
    automata = {k: lic.Automaton(t) for k, t in lic.TEMPLATES.items()}
    got = lic.scan_text(text.encode(), automata, {b" apache license version 2 ": "apache-2"})
    assert got == (8, 1, 3, 3, "apache-2", "apache-2,notice-apache-2.0", 1.0)
    assert lic.scan_text(b"licensed over the apache license version 2 0", automata, {b" apache license version 2 ": "apache-2"})[-1] == 0.6


def filled(template):
    """The template's wording with its optional regions and the fewest replaceable words."""
    words = re.sub(r"<<any:(\d+)-\d+>>", lambda m: "someone " * int(m[1]), template)
    return re.sub(r"<<(?:optional|end)>>", " ", words).split()


def test_whole_texts_and_altered_ones():
    automata = {k: lic.Automaton(t) for k, t in lic.TEMPLATES.items()}
    for label in [k for k in lic.TEMPLATES if k.startswith("text-")]:
        words = filled(lic.TEMPLATES[label])
        scan = lambda w: {x for x in lic.scan_text(" ".join(["Copyright (c)", *w, "End."]).encode(), automata, {})[5].split(",") if x.startswith("text-")}
        assert scan(words) == {label}
        # Mandatory wording: a word less at the start, in the middle or at the end, another word, a line more.
        mandatory = [i for i, w in enumerate(words) if w not in ("someone", "or", "including", "next", "paragraph", "the")]
        for i in (mandatory[0], mandatory[len(mandatory) // 2], mandatory[-1]):
            assert not scan(words[:i] + words[i + 1 :]) and not scan([*words[:i], "other", *words[i + 1 :]])


def test_template_of_a_text():
    a = lic.Automaton(lic.template_of("Do What You Want -- Über-Lizenz, v1.0"))
    assert a.found("x do what you want Über lizenz v1 0 y".encode().split()) and not a.found(b"do what you want lizenz v1 0".split())


def test_cases(spark):
    texts = [None, "", "under the MIT license under the mit license", "CC-BY-NC cc by nc by nc", "Über the mit license", "a " * 30000 + "Apache License, Version 2.0", "cc by\xa0nc", "cc by nc"]
    docs = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in lic.scan(docs).collect()}
    assert got == {(i // 2, *brute(t)) for i, t in enumerate(texts)}
    assert lic.scan(docs.limit(0)).count() == 0


def test_corpus(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in lic.op9_licenses(spark, folder).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
