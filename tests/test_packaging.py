"""What stands when the text-preparation part is not there, and values that must not drift."""

import os
import subprocess
import sys

from votemill import constants as C

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_text_operators():
    code = ("import sys; sys.modules['votemill.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e\n"
            "names = e.queries()\n"
            "assert len(names) > 150 and 'pipeline' not in names and not any(n.startswith('op1') for n in names)\n"
            "assert set(e.oracle_sql()) <= set(names)")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-1500:]


def test_nothing_outside_imports_the_text_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "votemill")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "votemill.llm" not in f.read(), name


def test_fixed_values():
    assert (C.WINDOW_DAYS, C.MIN_CHANGE_GAP_DAYS, C.LOW_SAMPLE_BELOW) == (30, 7, 10)
    assert (C.TOPIC_HARD_THRESHOLD, C.TOPIC_DOMINANCE, C.TOPIC_MAX_PER_ITEM, C.TOPIC_MIN_TOKENS) == (0.15, 0.40, 3, 25)
    assert (C.EXPLAIN_MAX_SPEECH, C.EXPLAIN_MAX_SUMMARY) == (700, 3000)
    assert (C.WORDS_MIN_COUNT, C.WORDS_TOP_N, C.WORDS_MIN_LEN, C.WORDS_PRIOR) == (30, 30, 3, 1000.0)
    assert len(C.TOPIC_LEXICON) == 16 and C.TOPIC_LEXICON[0][3][0] == ("talous", 1.0) and C.COALITION_PERIODS[-1][1] is None
