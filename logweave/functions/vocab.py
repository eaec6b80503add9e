"""Fixed vocabularies and the stop-word list."""

from __future__ import annotations

# fixed values: the static significance vocabulary of the reference's static
# scorer, in its natural order, plus the unstemmed literal it adds.
SIGNIFICANT_WORDS = (
    "fail", "invalid", "loss", "drop",
    "timeout", "exceed", "mismatch", "unknown",
    "abort", "reject", "release", "disconnect",
    "retx", "nack", "corrupt",
)
SIGNIFICANT_LITERAL = "failure"

# fixed values: label weights of the dynamic scorer and its defaults
ANOMALOUS = "ANOMALOUS"
NORMAL = "NORMAL"
UNMATCHED = "UNMATCHED"
WEIGHT_ANOMALOUS = 10.0
WEIGHT_OTHER = 0.01

# Rule labeller (stands in for the remote classifier): a template is ANOMALOUS
# when its lower-cased text contains one of these failure terms, which spell
# out the classifier's instructions (allocation failures, out-of-memory,
# unexpected drops, radio link failures, sync loss, invalid parameters,
# timeouts, forced aborts); otherwise NORMAL (the instructions' default).
ANOMALY_RULE = r"fail|out of memory|unexpected|drop|rlf|radio link|loss|lost|invalid|timeout|timed out|abort"


def significant_stems() -> list[str]:
    from logweave.functions.stem import porter_stem

    stems = []
    for w in SIGNIFICANT_WORDS:
        s = porter_stem(w)
        if s not in stems:
            stems.append(s)
    if SIGNIFICANT_LITERAL not in stems:
        stems.append(SIGNIFICANT_LITERAL)
    return stems


# fixed values: the English stop words of the vectoriser that learns the significant words (the scikit-learn list, which
# is not Spark's own default), in alphabetical order. Pass another list to the chi-square operators to replace it.
STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although always am among
amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became
because become becomes becoming been before beforehand behind being below beside besides between beyond bill both
bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight
either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty
fill find fire first five for former formerly forty found four from front full further get give go had has hasnt have
he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc
indeed interest into is it its itself keep last latter latterly least less ltd made many may me meanwhile might mill
mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody
none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours
ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she
should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such
system take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon
these they thick thin third this those though three through throughout thru thus to together too top toward towards
twelve twenty two un under until up upon us very via was we well were what whatever when whence whenever where
whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why
will with within without would yet you your yours yourself yourselves
"""


def stop_words() -> tuple[str, ...]:
    """The stop words removed before term counts are taken."""
    return tuple(STOP_WORDS.split())
