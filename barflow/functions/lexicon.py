"""Word lists of the news sentiment, fixed values."""

POSITIVE = """
beat beats beaten bullish bullishness buy bought buying breakout breakouts growth growing gain gains gained
profit profits profitable surge surges surged strong strength positive positively upgrade upgraded upside
outperform outperformed outperformance record records recovery recover expansion expand expanding robust
optimistic optimism improve improved improvement improving rally rallied rising rise raises raised dividend
partnership contract order orders approval approved launch launched milestone innovation investment invest
investing
""".split()

NEGATIVE = """
bearish bearishness sell selling sold selloff breakdown breakdowns fall falls fell falling drop drops dropped
decline declines declined loss losses lost weak weakness negative negatively downgrade downgraded downside
underperform underperformed debt default lawsuit penalty fraud scandal investigation probe warning warns risk
risks concern concerns concerned crisis crash recession inflation layoff layoffs cut cuts slump slumped plunge
plunged plunging disappoint disappointed disappointing miss missed misses fraudulent
""".split()

STRONG_POSITIVE = "breakout surge surged record outperformance approved milestone".split()

STRONG_NEGATIVE = "crash plunge plunged fraud default scandal crisis".split()


def weight(token: str) -> float:
    """Weight of a word: strong lists first, then the plain ones."""
    if token in STRONG_POSITIVE:
        return 2.0
    if token in STRONG_NEGATIVE:
        return -2.0
    return float(token in POSITIVE) - float(token in NEGATIVE and token not in POSITIVE)
