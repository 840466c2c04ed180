"""The texts of prompts, templates and hints, which results have to repeat to the letter."""

SYSTEM = (
    "You are an expert lexicographer. You are given two sentences, each using the same target word (marked with <t> tags). Inside <think> tags, work out what the target word means "
    "in each sentence then compare the two senses. Then, after </think>, answer with a single JSON object and nothing else, with exactly these keys: "
    '"sense1" (string, the gloss of the target in sentence 1), "sense2" (string, the gloss of the target in sentence 2), and "same_sense" (boolean, true if the two '
    'uses share the same sense). Format: <think>...</think>\n{"sense1": ..., "sense2": ..., "same_sense": ...}'
)
STUDENT_TAIL = (
    'Do both sentences use the target word in the same sense? Respond with a single JSON object with keys "sense1", "sense2" (the gloss of the target in each sentence) '
    'and "same_sense" (boolean).'
)
TEACHER_TAIL = "Are the two <t>...</t> uses the same sense?\n"
NO_MENTION = "Do not mention this hint; reason to it from the sentences themselves."
REPROMPT_TAIL = "\nNow answer the original question, reasoning in <think> tags and ending with the required JSON object.\n"
SOLUTION_HEAD = "\nHere is a correct answer to this pair from an earlier attempt:\n\n"
FILLER_WORD = "bank"
FILLER_USAGE = "She deposited her paycheck at the bank on Friday morning."
JUDGE_AXES = ("english", "coherent", "faithful", "consistent")
JUDGE = '''You are grading a reasoning trace produced by a language model for a word-in-context task. The task: decide whether a target word carries the SAME sense in two sentences.

Target word: {lemma} ({pos})
Sentence 1: {sentence1}
Sentence 2: {sentence2}

GOLD ANSWER (ground truth): same_sense = {gold}

The sense JSON the trace was paired with:
{answer}

The reasoning trace to grade:
"""
{reasoning}
"""

Grade the trace on exactly four independent criteria:

- "english": the trace is written entirely in fluent English. false if any other language appears, even partially.
- "coherent": the trace is a well-formed, on-topic argument about the sense of the target word. false if it is truncated mid-thought, repeats itself, rambles, or never actually discusses the target word.
- "faithful": the conclusion the trace reaches agrees with the GOLD ANSWER above. false if the trace concludes the senses are the same when gold says different, or vice versa. Grade only the conclusion, not the elegance of the argument.
- "consistent": the trace's argument actually supports the sense JSON it was paired with. false if the trace's glosses contradict sense1/sense2, or its stated conclusion contradicts the JSON's same_sense field.

Reply with ONLY a JSON object with these four boolean keys.'''
