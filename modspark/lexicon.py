"""Weighted term table of the rules scorer (own wording, hundredths of a point).

A term carries one weight per label.  Points add up over the text and a label's
score is ``points / (points + HALF_POINT)``, so one strong word lands in MEDIUM
and two in HIGH.
"""

from modspark.constants import LABELS

HALF_POINT = 40

_ROWS = """
term        toxic severe obscene threat insult hate
idiot       60    0      0       0      60     0
moron       60    0      0       0      60     0
clown       50    0      0       0      50     0
loser       50    0      0       0      50     0
fool        40    0      0       0      40     0
stupid      40    0      0       0      40     0
pathetic    40    0      0       0      40     0
worthless   50    0      0       0      50     0
scum        70    20     0       0      60     20
trash       40    0      0       0      40     0
garbage     30    0      0       0      30     0
vermin      80    30     0       0      60     60
freak       50    0      0       0      50     0
bastard     70    20     60      0      60     0
damn        20    0      20      0      0      0
shit        50    10     60      0      10     0
bitch       80    30     80      0      70     10
asshole     80    20     80      0      70     0
fuck        80    30     90      0      30     0
fucking     80    30     90      0      30     0
retard      80    30     20      0      80     50
kill        60    30     0       90     0      0
murder      60    40     0       90     0      0
hurt        20    0      0       30     0      0
hate        20    0      0       0      10     20
terrorist   50    20     0       10     40     70
bewakoof    60    0      0       0      60     0
gadha       60    0      0       0      60     0
nalayak     60    0      0       0      60     0
harami      80    30     70      0      70     0
kutte       70    20     40      0      70     0
chutiya     90    40     90      0      80     0
madarchod   95    70     95      0      80     0
बेवकूफ      60    0      0       0      60     0
हरामी       80    30     70      0      70     0
कमीने       70    20     40      0      70     0
"""


def default_lexicon() -> dict[str, list[int]]:
    """term -> six integer weights in label order."""
    rows = [r.split() for r in _ROWS.strip().splitlines()[1:]]
    return {r[0]: [int(v) for v in r[1 : 1 + len(LABELS)]] for r in rows}
