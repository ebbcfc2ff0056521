"""Reward metrics of preference pairs from stored log-probabilities.

DPO: Rafailov et al. 2023. IPO: Azar et al. 2023; its log-probabilities are
means per token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BETA = 0.1


def _softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pair_rewards(pairs: DataFrame, loss: str = "sigmoid", beta: float = BETA) -> DataFrame:
    """Add rewards, margin, accuracy and loss to pairs with ``policy_chosen``,
    ``policy_rejected``, ``ref_chosen`` and ``ref_rejected``; for IPO also
    ``n_chosen`` and ``n_rejected`` tokens."""
    if loss not in ("sigmoid", "ipo"):
        raise ValueError(f"loss {loss!r} is neither sigmoid nor ipo")

    def logp(who: str, side: str) -> Column:
        value = F.col(f"{who}_{side}")
        return value / F.col(f"n_{side}") if loss == "ipo" else value

    gain = {s: logp("policy", s) - logp("ref", s) for s in ("chosen", "rejected")}
    h = gain["chosen"] - gain["rejected"]
    term = F.pow(h - 1.0 / (2.0 * beta), F.lit(2.0)) if loss == "ipo" else _softplus(-beta * h)
    return pairs.withColumns(
        {
            "logp_chosen": logp("policy", "chosen"),
            "logp_rejected": logp("policy", "rejected"),
            "reward_chosen": beta * gain["chosen"],
            "reward_rejected": beta * gain["rejected"],
            "margin": beta * h,
            "accuracy": (gain["chosen"] > gain["rejected"]).cast("double"),
            "loss": term,
        }
    )


def reward_metrics(
    pairs: DataFrame, *by: str, loss: str = "sigmoid", beta: float = BETA
) -> DataFrame:
    """Means of the pair metrics per group, as the training log shows them."""
    named = {
        "rewards_chosen": "reward_chosen", "rewards_rejected": "reward_rejected",
        "rewards_margins": "margin", "rewards_accuracies": "accuracy",
        "logps_chosen": "logp_chosen", "logps_rejected": "logp_rejected", "loss": "loss",
    }
    return pair_rewards(pairs, loss, beta).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), *[F.avg(c).alias(n) for n, c in named.items()]
    )
