"""Term weights of the metric lexicons and topics; both are defaults that a caller may replace."""

from __future__ import annotations

# Weighted terms of each lexicon, in order.
METRICS: dict[str, dict[str, float]] = {
    "forward": {
        "guidance": 1.0, "outlook": 1.0, "expect": 0.8, "expects": 0.8, "expected": 0.8, "forecast": 1.0, "projection": 0.9, "project": 0.8,
        "target": 0.9, "targets": 0.9, "next quarter": 1.3, "next year": 1.2, "full year": 1.1, "fiscal year": 1.0, "pipeline": 0.9,
        "visibility": 0.8, "momentum": 0.8, "ramp": 0.9, "roadmap": 1.0, "launch": 0.8, "expansion": 0.8, "growth": 0.7, "long term": 1.0,
        "medium term": 0.9, "near term": 0.8, "we see": 0.7, "we anticipate": 1.0, "tailwind": 0.9, "upside": 0.8, "catalyst": 0.7, "back half": 0.8,
        "second half": 0.8,
    },
    "risk": {
        "risk": 0.8, "risks": 0.8, "headwind": 1.0, "headwinds": 1.0, "pressure": 0.9, "pressures": 0.9, "uncertain": 1.0, "uncertainty": 1.0,
        "volatile": 0.9, "volatility": 0.9, "challenging": 0.8, "softness": 1.0, "downturn": 1.0, "recession": 1.1, "slowdown": 1.0,
        "constraint": 0.8, "constraints": 0.8, "supply constraint": 1.0, "geopolitical": 1.0, "tariff": 1.0, "regulatory": 0.8, "litigation": 1.0,
        "lawsuit": 1.0, "cybersecurity": 0.8, "security incident": 1.0, "execution risk": 1.1, "foreign exchange": 0.9, "fx": 0.7, "inflation": 0.9,
        "deflation": 0.8, "pricing pressure": 1.1, "inventory correction": 1.2, "demand destruction": 1.3, "credit risk": 1.1, "default": 0.9,
        "defaults": 0.9, "churn": 1.0, "attrition": 0.8, "impairment": 1.0, "write-down": 1.0, "writeoff": 1.0, "deceleration": 1.0, "delay": 0.8,
        "delays": 0.8, "disruption": 1.0,
    },
    "hedge": {
        "may": 0.8, "might": 0.9, "could": 0.8, "assuming": 1.0, "subject to": 1.1, "we believe": 0.9, "we think": 0.9, "we feel": 0.8,
        "it depends": 1.0, "not going to comment": 1.2, "cannot comment": 1.2, "can't comment": 1.2, "too early": 1.1, "early to say": 1.1,
        "hard to predict": 1.2, "limited visibility": 1.2, "no guarantee": 1.3, "unclear": 1.0, "approximately": 0.7, "roughly": 0.7, "around": 0.6,
        "about": 0.5, "potentially": 0.9, "probably": 0.8, "likely": 0.6, "to the extent": 1.0, "at this time": 0.8, "not yet": 0.8, "we'll see": 1.1,
        "remains to be seen": 1.3, "where appropriate": 1.0, "opportunistically": 0.9, "at a high level": 1.1, "directionally": 1.0,
    },
    "specificity": {
        "basis points": 1.2, "bps": 1.2, "percent": 0.6, "million": 0.9, "billion": 0.9, "trillion": 0.9, "guidance range": 1.1, "range": 0.6,
        "contract": 0.8, "contracts": 0.8, "customer": 0.8, "customers": 0.8, "units": 0.8, "utilization": 0.9, "gross margin": 1.0,
        "operating margin": 1.0, "free cash flow": 1.0, "opex": 0.8, "capex": 0.8, "eps": 0.8, "revenue": 0.8, "backlog": 0.9, "bookings": 0.9,
        "inventory days": 1.0, "headcount": 0.8, "market share": 1.0, "roi": 0.9,
    },
    "forward_counter": {
        "headwind": 1.0, "headwinds": 1.0, "uncertain": 1.0, "uncertainty": 1.0, "pressure": 0.9, "pressures": 0.9, "slowdown": 1.0, "softness": 1.0,
        "volatility": 1.0, "challenging": 0.9, "timing dependent": 1.0, "not committed": 1.1,
    },
    "confidence": {
        "on track": 1.0, "executed": 1.0, "delivered": 1.0, "visibility": 0.9, "disciplined": 0.8, "consistent": 0.8, "repeatable": 0.9,
        "raising guidance": 1.2, "raise guidance": 1.2, "confident": 0.9, "committed": 0.9,
    },
    "confidence_counter": {
        "unclear": 1.0, "uncertain": 1.1, "too early": 1.2, "cannot comment": 1.3, "can't comment": 1.3, "not prepared": 1.1,
        "limited visibility": 1.2, "remains to be seen": 1.3, "we'll see": 1.2,
    },
    "specificity_counter": {
        "various": 0.8, "several": 0.8, "many": 0.7, "some": 0.6, "kind of": 1.0, "sort of": 1.0, "at a high level": 1.2, "directionally": 1.0,
        "broadly": 0.9, "roughly": 0.9, "approximately": 0.8,
    },
    "directness": {
        "specifically": 1.0, "to be clear": 1.1, "exactly": 1.0, "we will": 0.9, "we did": 0.8, "we have": 0.8, "the number is": 1.2,
        "guidance is": 1.0, "we can commit": 1.2,
    },
}

# Weighted terms of each topic; among equal densities the earlier topic wins.
TOPICS: dict[str, dict[str, float]] = {
    "demand": {
        "demand": 1.2, "orders": 1.2, "bookings": 1.1, "backlog": 1.2, "sell-through": 1.0, "sell through": 1.0, "consumption": 0.8,
    },
    "margins": {
        "margin": 1.1, "gross margin": 1.3, "operating margin": 1.3, "profitability": 1.0, "mix": 0.6, "incremental margin": 1.0,
    },
    "guidance": {
        "guidance": 1.3, "outlook": 1.2, "expect": 0.9, "forecast": 1.1, "next quarter": 1.1, "full year": 1.1,
    },
    "capex": {
        "capex": 1.3, "investment": 0.9, "infrastructure": 1.0, "capacity": 1.0, "datacenter": 1.1, "data center": 1.1,
    },
    "costs": {
        "cost": 1.0, "costs": 1.0, "expense": 1.0, "expenses": 1.0, "opex": 1.1, "efficiency": 0.9, "productivity": 0.8, "restructuring": 0.9,
    },
    "pricing": {
        "pricing": 1.2, "price": 0.9, "discount": 0.9, "asp": 1.0, "average selling price": 1.0, "promotion": 0.7,
    },
    "competition": {
        "competition": 1.2, "competitive": 1.0, "share": 0.8, "market share": 1.1, "rival": 1.0, "peer": 0.8,
    },
    "regulation": {
        "regulation": 1.2, "regulatory": 1.1, "compliance": 1.0, "antitrust": 1.2, "policy": 0.8, "tariff": 0.9, "export control": 1.2,
    },
    "ai": {
        "ai": 0.9, "artificial intelligence": 1.2, "machine learning": 1.0, "genai": 1.0, "inference": 1.0, "training": 1.0, "model": 0.7, "gpu": 0.8,
        "accelerator": 0.8,
    },
    "macro": {
        "macro": 1.0, "consumer": 0.7, "enterprise demand": 0.9, "recession": 1.0, "inflation": 1.0, "fx": 0.8, "foreign exchange": 1.0,
        "interest rate": 1.0,
    },
    "supply_chain": {
        "supply": 0.8, "supply chain": 1.2, "inventory": 1.0, "lead time": 1.0, "constraint": 0.9, "manufacturing": 0.8,
    },
    "cashflow": {
        "cash flow": 1.2, "free cash flow": 1.2, "working capital": 1.1, "balance sheet": 1.0, "debt": 0.9, "liquidity": 0.9, "buyback": 0.9,
    },
}
