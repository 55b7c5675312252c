"""Sentence templates filled from columns.

A template is plain text with ``{field}`` marks; ``render`` turns it into one ``concat``
expression, so texts are built inside generated code and never by a Python loop.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def render(template: str, **fields: Column) -> Column:
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [fields[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p]
    return F.concat(*parts)


# Wording of the action centre, one block per action type.
ACTION_TEXTS = {
    "Markdown": {
        "title": "{category} Overstock — {sku}",
        "issue": "Sell-through at {st}% — well below the 30% markdown trigger threshold. "
                 "Estimated {cover} weeks cover remaining at current rate of sale.",
        "root_cause": "Original intake volume exceeded consumer demand in {category}. "
                      "Rate of sale has not recovered to plan, and the stock position is classified as {grade}. "
                      "Continued full-price trading will result in further cover deterioration.",
        "recommended_action": "Apply {depth} markdown to {sku} immediately. "
                              "Prioritise digital/online channel for maximum velocity. "
                              "Review in-store placement and consider promotional support to accelerate clearance.",
        "expected_outcome": "Accelerate sell-through from {st}% to a projected 70–85% within 4–6 weeks. "
                            "Recover {cash} in cash. Reduce cover to a sustainable 4–6 week position.",
        "business_impact": "Releases {cash} working capital currently trapped in slow-moving stock. "
                           "Prevents the need for deeper, more damaging markdowns later in the season. "
                           "Clears floor and warehouse space for higher-margin intake.",
    },
    "Reorder": {
        "title": "Stockout Risk — {sku}",
        "issue": "Stock cover at {cover} weeks with sell-through at {st}%. "
                 "Current rate of sale will exhaust stock within {grade}.",
        "root_cause": "Strong consumer demand has depleted {sku} inventory faster than forecast. "
                      "No replenishment is currently scheduled. "
                      "Cover has fallen below the 4-week minimum trigger threshold.",
        "recommended_action": "Place emergency replenishment order for {sku} to restore 6–8 week cover. "
                              "Engage supplier to expedite lead time. "
                              "Allocate available stock to highest-revenue channels in the interim.",
        "expected_outcome": "Prevent stockout and recover {amount} in projected lost revenue. "
                            "Maintain full-price sell-through position and protect {category} category performance.",
        "business_impact": "Stockout prevention protects {amount} revenue at full margin ({margin}%). "
                           "Avoids lost customer trust and market share in {category}. "
                           "Maintains category momentum heading into remainder of season.",
    },
    "Intake Reduction": {
        "title": "Reduce {category} Forward Buying",
        "issue": "{category} category health is {grade} with {st}% sell-through. "
                 "Estimated {cover}+ weeks cover — exceeds the 20-week intake reduction trigger.",
        "root_cause": "Buy volume in {category} has consistently outpaced consumer demand. "
                      "Forward buying commitments risk compounding the existing overstock position "
                      "if not addressed before intake lands.",
        "recommended_action": "Reduce forward buying in {category} by 20–25% for next season's intake. "
                              "Review all open and uncommitted orders. "
                              "Identify and cancel or defer non-essential intake to bring cover to 8–12 week target.",
        "expected_outcome": "Prevent {amount} of excess stock accumulation. "
                            "Bring {category} cover into the sustainable 8–12 week target range. "
                            "Preserve {cash} in OTB budget for higher-performing categories.",
        "business_impact": "Reduces cash tied in slow-moving {category} stock. "
                           "Protects OTB budget and enables reallocation to stronger categories. "
                           "Improves overall business sell-through rate and margin efficiency.",
    },
    "PO Cancellation": {
        "title": "Cancel Incoming {category} Purchase Orders",
        "issue": "{category} current stock cannot realistically clear before new intake is scheduled to arrive. "
                 "Sell-through at {st}% with {grade} health status.",
        "root_cause": "Existing overstock in {category} combined with open purchase orders will create a compounding "
                      "inventory problem. Incoming stock will depress sell-through further and require deeper markdowns.",
        "recommended_action": "Immediately review all open and uncommitted {category} purchase orders. "
                              "Cancel or defer any non-confirmed POs within cancellation windows. "
                              "Engage supplier to negotiate deferral on committed orders.",
        "expected_outcome": "Prevent {cash} of additional unnecessary stock entering the business. "
                            "Protect cash flow and OTB budget. Reduce forward markdown exposure.",
        "business_impact": "Cancelling or deferring {category} POs saves {cash} in cash outflow. "
                           "Avoids compounding existing overstock and prevents further margin erosion. "
                           "Frees OTB for reallocation to higher-performing categories.",
    },
    "Stock Transfer": {
        "title": "Rebalance: {category}",
        "issue": "{source} is overstocked at {st}% sell-through while {target} is outperforming at {cover}% sell-through.",
        "root_cause": "Imbalanced stock allocation across categories. {source} received excess depth "
                      "relative to demand; {target} may face constraint on growth potential.",
        "recommended_action": "Investigate cross-channel stock transfer opportunities between {source} and {target}. "
                              "Assess if product formats, sizes or colourways are transferable. "
                              "Review store-by-store stock allocation for rebalancing potential.",
        "expected_outcome": "Better match of stock to consumer demand signals. "
                            "Estimated {amount} revenue improvement through optimised stock deployment.",
        "business_impact": "Reduces markdown requirement in {source} while supporting full-price "
                           "revenue growth in {target}. Improves overall stock efficiency across the business.",
    },
    "Supplier Review": {
        "title": "{category} — Commercial Renegotiation",
        "issue": "{category} delivering {margin}% margin with {st}% sell-through. "
                 "Both metrics are below commercial viability thresholds of 40% margin and 40% sell-through.",
        "root_cause": "Cost prices in {category} may not reflect current market conditions or range productivity. "
                      "Poor sell-through combined with low margin signals a fundamental commercial viability issue "
                      "that requires supplier-level review.",
        "recommended_action": "Initiate cost price renegotiation with {category} suppliers. Target minimum 48% margin. "
                              "Review product range architecture and pricing strategy. "
                              "If renegotiation is unsuccessful, consider exiting the category.",
        "expected_outcome": "Potential margin improvement of {amount} if cost prices reach the 48% threshold. "
                            "Long-term commercial viability of the {category} category established.",
        "business_impact": "Improves {category} commercial contribution to the business. "
                           "Either establishes a viable margin floor or provides data to support a category exit decision. "
                           "Protects OTB investment in productive, margin-accretive categories.",
    },
}
TEXT_FIELDS = ["title", "issue", "root_cause", "recommended_action", "expected_outcome", "business_impact"]
