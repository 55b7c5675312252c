"""Column roles: which header of an uploaded sheet means what.

Role matching looks at header names only, once per file. The roles a sheet has are carried on its lines as one
integer (``role_mask``), which keeps "column absent" apart from "cell empty" without a
join of every line with the dataset table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Accepted header names per role, in order of preference.
ROLE_HEADERS = {
    "sku": ["SKU", "ProductCode", "ItemCode", "Style", "StyleCode"],
    "units": ["UnitsSold", "Units", "Qty", "Quantity", "SalesUnits", "Pieces"],
    "revenue": ["Revenue", "Sales", "SalesValue", "TotalRevenue", "NetSales", "TotalSales", "Turnover"],
    "stock": ["StockOnHand", "Stock", "OnHand", "CurrentStock", "Inventory", "ClosingStock", "UnitsOnHand"],
    "cost": ["CostPrice", "Cost", "UnitCost", "BuyingPrice", "COGS"],
    "margin_pct": ["MarginPct", "Margin", "GrossMarginPct", "GM%", "GMPct", "GrossMargin", "Margin%", "GP%"],
    "margin_value": ["Margin£", "MarginGBP", "MarginValue", "GrossMargin£", "GM£", "GMGBP",
                     "GrossProfit", "Profit£", "ProfitGBP", "Profit"],
    "retail": ["RetailPrice", "RRP", "SellingPrice", "UnitPrice", "TicketPrice", "Price", "SRP"],
    "sell_through": ["SellThrough", "SellThroughPct", "ST", "S/T", "SellThrough%", "SellThru", "STR"],
    "cover_weeks": ["StockCoverWeeks", "CoverWeeks", "WeeksCover", "Cover", "WOS", "WeeksofStock"],
    "category": ["Category", "Department", "Dept", "ProductType", "Division", "Class", "Subclass"],
    "channel": ["Channel", "SalesChannel", "Store", "Region", "Location", "Market"],
    "week": ["Week", "WeekNumber", "Period", "WeekNo", "TradingWeek", "Wk"],
    "name": ["ProductName", "Name", "Description", "Desc", "ProductDescription", "StyleName"],
    "brand": ["Brand", "BrandName", "Label", "Supplier"],
    "buy_qty": ["BuyQty", "OpeningStock", "InitialStock", "IntakeQty"],
    "full_price_sales": ["FullPriceSales", "FPSales", "FullPriceRevenue", "FPRevenue"],
}
REQUIRED = {"sku": "SKU", "units": "UnitsSold", "revenue": "Revenue"}
# Headers that mark a table as trading data.
KEY_HEADERS = ["sku", "productcode", "itemcode", "revenue", "sales", "unitssold", "units", "qty",
               "stockonhand", "stock"]

ROLES = list(ROLE_HEADERS)
ALL_ROLES = (1 << len(ROLES)) - 1


def squash(header: str) -> str:
    """Header name without case, spaces and underscores."""
    return header.lower().replace(" ", "").replace("_", "")


def role_positions(columns: list[str]) -> dict[str, int]:
    """Role -> position of its column. Of headers that differ in case, spaces or underscores
    only, the last counts; of those that are spelt alike, the first."""
    present = {}
    for i, c in enumerate(columns):
        if c not in columns[:i]:
            present[squash(c)] = i
    hits = {role: next((present[squash(n)] for n in names if squash(n) in present), None) for role, names in ROLE_HEADERS.items()}
    return {role: i for role, i in hits.items() if i is not None}


def resolve_roles(columns: list[str]) -> dict[str, str]:
    """Role -> name of its column."""
    return {role: columns[i] for role, i in role_positions(columns).items()}


def missing_required(columns: list[str]) -> str | None:
    """Reason to reject a sheet, or None when SKU, units and revenue are all present."""
    found = resolve_roles(columns)
    absent = [label for role, label in REQUIRED.items() if role not in found]
    if not absent:
        return None
    shown = ", ".join(columns[:10]) + ("..." if len(columns) > 10 else "")
    return f"Missing required columns: {', '.join(absent)}. Found columns: {shown}."


def mask_of(roles) -> int:
    return sum(1 << ROLES.index(r) for r in roles)


def has_role(role: str, mask: str = "role_mask") -> Column:
    """True on rows whose sheet has the given column."""
    return F.col(mask).bitwiseAND(F.lit(1 << ROLES.index(role))) != 0


def roles_present(mask: str = "role_mask") -> Column:
    """The mask as an array of role names."""
    return F.array_compact(F.array(*[F.when(has_role(r, mask), F.lit(r)) for r in ROLES]))
