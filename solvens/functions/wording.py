"""Rules for reader-facing sentences: which branch applies, and what it says.

The branch limits are fixed values; the sentences are ours.  A rule is
(test on the value, side or None, sentence).  In a sentence, ``{x}`` is the
value with two decimals and an x, ``{n}`` with two decimals, ``{p}`` a percentage
and ``{t}`` the formatted value of the feature; ``{name}`` its display name.
"""

from __future__ import annotations

RISK, HEALTH = "risk", "health"

# (test, side, sentence); tests are SQL over ``v`` and are tried in order.
DETAILED = {
    "Interest_Coverage": [
        ("v < 0", None, "Operations lose money before interest, so nothing is earned towards interest payments."),
        ("v < 1.0", None, "Coverage of {x} is under 1.0x: a year of operating profit does not pay a year of interest."),
        ("v < 2.0", RISK, "Interest is earned {x}, less than twice, and the score counts it as a risk."),
        ("v < 2.0", HEALTH, "Interest is earned {x}, less than twice, yet the score counts it in favour."),
        (None, None, "Coverage of {x} pays interest several times over."),
    ],
    "Debt_to_Equity": [
        ("v >= 10.0 or v < 0", None, "Debt is ten times equity or more, or there is no equity left to compare it with."),
        ("v > 3.0", None, "At {x}, debt is more than three times equity."),
        ("v > 1.5", RISK, "At {x}, debt is over one and a half times equity, and the score counts it as a risk."),
        ("v > 1.5", HEALTH, "At {x}, debt is over one and a half times equity, yet the score counts it in favour."),
        (None, None, "At {x}, debt is one and a half times equity at most."),
    ],
    "Operating_Margin": [
        ("v < 0", None, "The operating margin is {p}: the core business runs at a loss."),
        ("v < 0.05", None, "The operating margin is {p}, under 5% of sales."),
        (None, None, "The operating margin is {p}, 5% of sales or more."),
    ],
    "ROA": [
        ("v < 0", None, "Return on assets is {p}: the asset base loses money."),
        ("v < 0.03", None, "Return on assets of {p} is modest for the capital tied up."),
        (None, None, "Return on assets of {p} shows capital put to good use."),
    ],
    "ROE": [
        ("v < 0", None, "Return on equity is {p}: book value is shrinking."),
        (None, None, "Return on equity of {p} rewards the owners."),
    ],
    "Cash_to_Debt": [
        ("v < 0.1", None, "Cash is {x} of debt, under a tenth of what is owed."),
        (None, None, "Cash of {x} debt helps to meet maturities."),
    ],
    "Working_Capital_Ratio": [
        ("v < 0", None, "Working capital is negative ({n}): short-term dues exceed short-term assets."),
        (None, None, "A working capital ratio of {n} keeps daily business liquid."),
    ],
    "Net profit": [
        ("v < 0", None, "A net loss of {t} eats into reserves and net worth."),
        (None, None, "A net profit of {t} adds to equity and can repay debt."),
    ],
    "Operating Profit": [
        ("v < 0", None, "An operating result of {t} means the business cannot fund its own costs."),
        (None, None, "An operating profit of {t} is the first source for debt payments."),
    ],
    "Borrowings": [
        (None, RISK, "Borrowings of {t} cost much interest and need refinancing."),
        (None, HEALTH, "Borrowings of {t} are in proportion to what the business earns."),
    ],
    "Cash from Operating Activity": [
        ("v < 0", None, "Operating cash flow of {t} is an outflow that outside lenders must cover."),
        (None, None, "Operating cash flow of {t} funds liabilities from within."),
    ],
    "Borrowing_Growth": [
        ("v > 0.15", None, "Debt grew by {p}, faster than a company can usually carry from its own cash."),
        ("v <= 0", None, "Debt changed by {p}: the balance sheet is being relieved."),
        (None, None, "Debt grew by {p}, in step with the business."),
    ],
    "Revenue_Growth": [
        ("v < 0", None, "Revenue changed by {p}, which leaves less cash for lenders."),
        (None, None, "Revenue grew by {p} and widens the room for debt payments."),
    ],
    "Profit_Growth": [
        ("v < 0", None, "Net profit changed by {p}, a weaker buffer for repayment."),
        (None, None, "Net profit grew by {p} and builds resilience."),
    ],
    "Asset_Growth": [
        ("v < 0", None, "Assets changed by {p}, possibly through impairments or disposals."),
        (None, None, "Assets grew by {p} and add capacity."),
    ],
    "Operating_CF_Growth": [
        ("v < 0", None, "Operating cash flow changed by {p} and tightens liquidity."),
        (None, None, "Operating cash flow grew by {p} and supports liquidity."),
    ],
}
DETAILED_OTHER = [
    (None, RISK, "The reported {name} ({t}) weighs on solvency."),
    (None, HEALTH, "The reported {name} ({t}) supports the balance sheet."),
]

CONCISE = {
    "Interest_Coverage": [
        ("v < 0", None, "Operating losses leave nothing for interest."),
        ("v < 1.0", None, "Interest is not earned: coverage is {x}, below 1.0x."),
        ("v < 2.0", None, "Coverage of {x} leaves a thin margin."),
        (None, None, "Interest is earned {x}."),
    ],
    "Debt_to_Equity": [
        ("v >= 10.0 or v < 0", None, "Extreme debt or negative equity."),
        ("v > 3.0", None, "High debt of {x} equity."),
        ("v > 1.5", None, "Moderate debt of {x} equity."),
        (None, None, "Low debt of {x} equity."),
    ],
    "Operating_Margin": [
        ("v < 0", None, "Core operations lose money ({p})."),
        ("v < 0.05", None, "Thin margin of {p}."),
        (None, None, "Sound margin of {p}."),
    ],
    "Net profit": [
        ("v < 0", None, "Net loss of {t}."),
        (None, None, "Net profit of {t}."),
    ],
    "Operating Profit": [
        ("v < 0", None, "Operating loss of {t}."),
        (None, None, "Operating profit of {t}."),
    ],
    "ROA": [
        ("v < 0", None, "Negative return on assets ({p})."),
        (None, None, "Return on assets of {p}."),
    ],
    "ROE": [
        ("v < 0", None, "Negative return on equity ({p})."),
        (None, RISK, "Return on equity of {p}, weak or inflated by debt."),
        (None, HEALTH, "Return on equity of {p}."),
    ],
    "Borrowings": [
        (None, RISK, "Heavy borrowings of {t}."),
        (None, HEALTH, "Borrowings of {t} that earnings can carry."),
    ],
    "Cash_to_Debt": [
        ("v < 0.1", None, "Cash covers under a tenth of debt ({x})."),
        (None, None, "Cash covers {x} of debt."),
    ],
    "Working_Capital_Ratio": [
        ("v < 0", None, "Negative working capital ({n})."),
        (None, None, "Working capital ratio of {n}."),
    ],
    "Cash from Operating Activity": [
        ("v < 0", None, "Operations burn cash ({t})."),
        (None, None, "Operations bring in {t}."),
    ],
    "Revenue_Growth": [
        ("v < 0", None, "Sales are shrinking ({p})."),
        (None, None, "Sales are growing ({p})."),
    ],
    "Borrowing_Growth": [
        ("v > 0.15", None, "Debt is growing fast ({p})."),
        (None, None, "Debt growth is under control ({p})."),
    ],
}
CONCISE_OTHER = [(None, None, "{name} ({t}) plays a part in solvency.")]

# Per class: opening after the confidence, and the phrase when no factor is listed.
# ``{ic}``, ``{de}``, ``{om}`` are coverage, debt/equity and margin, ``{factors}`` the first two factors.
_FACTS = "Class {name}, {{conf}}% sure. Interest is earned {{ic}}, debt to equity is {{de}}, the operating margin {{om}}. {end}"
SUMMARIES = {
    "Healthy": (_FACTS.format(name="Healthy", end="What speaks for it most: {factors}."), HEALTH, "no single figure"),
    "Financial Distress": (_FACTS.format(name="Financial Distress", end="What to look at first: {factors}."), RISK, "the figures as a whole"),
    "Probably Bankrupt": (_FACTS.format(name="Probably Bankrupt", end="What weighs most: {factors}."), RISK, "the figures as a whole"),
    "Bankrupt": (_FACTS.format(name="Bankrupt", end="What decided it: {factors}."), RISK, "the figures as a whole"),
}

# Indicator, column, value format, benchmark, cut-offs, and the
# limit from which the good implication is given.  Sentences are ours.
INDICATORS = [
    ("Interest Coverage Ratio", "interest_coverage", "x", "≥ 2.50x", (2.5, 1.5, 1.0), 2.5, "Earns its interest 2.5 times or more", "Earns its interest fewer than 2.5 times"),
    ("Debt-to-Equity Ratio", "debt_to_equity", "x", "≤ 1.50x", None, None, "Owes 1.5 per unit of equity at most", "Owes more than 1.5 per unit of equity, or has no equity"),
    ("Operating Margin", "operating_margin", "p", "≥ 12.0%", (0.12, 0.05, 0.0), 0.05, "Keeps 5% of sales or more", "Keeps less than 5% of sales"),
    ("Return on Assets (ROA)", "roa", "p", "≥ 5.0%", (0.05, 0.01, 0.0), 0.01, "Earns 1% on assets or more", "Earns less than 1% on assets"),
    ("Return on Equity (ROE)", "roe", "p", "≥ 12.0%", (0.12, 0.05, 0.0), 0.05, "Earns 5% on equity or more", "Earns less than 5% on equity"),
    ("Working Capital Ratio", "working_capital_ratio", "n", "≥ 0.15", (0.15, 0.05, 0.0), 0.05, "Working capital is 0.05 or more", "Working capital is under 0.05"),
]
STATUSES = ["Strong", "Moderate", "Concerning", "Critical"]
COLOURS = {"Strong": "green", "Moderate": "yellow", "Concerning": "orange", "Critical": "red", "Unknown": "grey"}
