"""Schemas of the entities that operators exchange."""

PAIR = "lemma string, pos string, word1 string, sentence1 string, word2 string, sentence2 string, label string"
TEACHER = "lemma string, pos string, sentence1 string, sentence2 string, usage1 string, usage2 string, label string, prediction boolean, confidence double, votes array<boolean>, answers array<string>, reasonings array<string>, error string"
ANNOTATION = "text string, sent_id string, start int, end int, lemma string, pos string, synsets array<string>"
GOLD_PAIR = "lemma string, pos string, label boolean, sentence1 string, sentence2 string, usage1 string, usage2 string, synset1 string, synset2 string, gloss1 string, gloss2 string, senses array<string>"
GLOSS = "lemma string, word string, pos string, usage string, definition string"
GLOSS_ROW = GLOSS + ", gloss string, filler_gloss string, think string"
LEXICON = "lemma string, pos string, rank int, synset_id string, definition string"
SYNSET_EDGES = "synset_id string, hypernym_id string"
VERDICT = "lemma string, pos string, sentence1 string, sentence2 string, slot int, stage string, keep boolean, reason string, scores map<string,boolean>"
PAIR_KEY = ("lemma", "pos", "sentence1", "sentence2")
