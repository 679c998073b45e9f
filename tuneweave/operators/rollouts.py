"""Rollout-log analytics (R1-R9, F5) as higher-order functions on array
columns: one row per sequence, every per-token rule stays inside the row, so
these run map-side with no shuffle; batch losses are ordinary aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.specials import CLIP_RANGE, CLIP_RANGE_VALUE, CLIP_REWARD_VALUE, GAMMA, KL_CTL, LAM
from .recurrence import discounted_tails


def _d(arr: Column) -> Column:
    return arr.cast("array<double>")


def log_softmax_at(logits: Column, label: Column) -> Column:
    """``logit[label] - max - ln(sum(exp(logit - max)))`` (0-based label)."""
    x = _d(logits)
    m = F.array_max(x)
    s = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))
    return F.get(x, label) - m - F.log(s)


def action_mask(attention_mask: Column) -> Column:
    """``attention_mask[1:]`` (length L-1)."""
    return F.slice(attention_mask, 2, F.size(attention_mask) - 1)


def reward_end(mask: Column, start: Column) -> Column:
    """``end = start + sum(mask[start:]) + 1`` over the action mask."""
    tail = F.slice(mask, start + 1, F.size(mask))
    return start + F.aggregate(tail, F.lit(0), lambda a, v: a + v.cast("int")) + 1


def kl_rewards(logprobs: Column, ref_logprobs: Column, mask: Column, start: Column,
               reward_score: Column, kl_ctl: float = KL_CTL,
               clip: float = CLIP_REWARD_VALUE) -> Column:
    """``-kl*(lp - ref)`` plus the clipped score added at the last
    position of ``[start, end)`` (the slice stops at the array end)."""
    n = F.size(logprobs)
    end = reward_end(mask, start)
    last = F.least(end, n) - 1
    bonus = F.least(F.greatest(reward_score.cast("double"), F.lit(-clip)), F.lit(clip))
    base = F.zip_with(_d(logprobs), _d(ref_logprobs), lambda a, b: F.lit(-kl_ctl) * (a - b))
    return F.transform(base, lambda r, i: F.when(i == last, r + bonus).otherwise(r))


def zero_from(arr: Column, end: Column) -> Column:
    """Values at positions ``>= end`` set to zero."""
    return F.transform(_d(arr), lambda v, i: F.when(i >= end, F.lit(0.0)).otherwise(v))


def advantages_returns(values: Column, rewards: Column, start: Column,
                       gamma: float = GAMMA, lam: float = LAM) -> Column:
    """Generalised advantage estimation from ``start``; returns
    ``struct(advantages, returns)`` (both of length ``n - start``; null where an input is).

    The backward recurrence ``adv = delta + gamma * lam * adv_after`` runs over the flat
    values of a whole Arrow batch of rows at once, as a scan of affine maps; nothing is
    copied per position."""
    factor, gamma = float(gamma) * float(lam), float(gamma)

    @F.arrow_udf("struct<advantages:array<double>,returns:array<double>>")
    def estimate(v: pa.Array, r: pa.Array, s: pa.Array) -> pa.Array:
        fine = pc.and_(pc.and_(v.is_valid(), r.is_valid()), s.is_valid())
        keep = np.flatnonzero(fine.to_numpy(zero_copy_only=False))
        rows, owed = v.take(keep), r.take(keep)
        sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.clip(s.take(keep).to_numpy(zero_copy_only=False).astype(np.int64), 0, sizes)
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        given = owed.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat) != len(given):
            raise ValueError("values and rewards differ in length")
        ends = np.zeros(len(flat), bool)
        ends[np.cumsum(sizes)[sizes > 0] - 1] = True
        after = np.where(ends, 0.0, np.append(flat[1:], 0.0)) if len(flat) else flat
        advantages = discounted_tails(given + gamma * after - flat, factor, ends)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = np.arange(len(flat)) - begin >= np.repeat(first, sizes)
        lengths = np.zeros(len(v), np.int64)
        lengths[keep] = sizes - first
        offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[inside])) for x in (advantages, advantages + flat)]
        return pa.StructArray.from_arrays(lists, names=["advantages", "returns"], mask=pc.invert(fine))

    return estimate(_d(values), _d(rewards), start.cast("int"))


def policy_loss_terms(logprobs: Column, old_logprobs: Column, advantages: Column, mask: Column,
                      cliprange: float = CLIP_RANGE) -> Column:
    """R6 per row: ``struct(num, den)`` of the clipped policy loss; the batch
    loss is ``sum(num) / sum(den)``."""
    lo, hi = 1.0 - cliprange, 1.0 + cliprange
    m = _d(mask)
    ratio = F.zip_with(F.zip_with(_d(logprobs), _d(old_logprobs), lambda a, b: a - b), m,
                       lambda d, k: F.exp(d * k))
    terms = F.zip_with(F.zip_with(ratio, _d(advantages), lambda q, a: F.struct(q.alias("q"), a.alias("a"))),
                       m, lambda s, k: F.greatest(-s["a"] * s["q"],
                                                  -s["a"] * F.least(F.greatest(s["q"], F.lit(lo)), F.lit(hi))) * k)
    num = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    den = F.aggregate(m, F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(num.alias("num"), den.alias("den"))


def value_loss_terms(values: Column, old_values: Column, returns: Column, mask: Column,
                     cliprange_value: float = CLIP_RANGE_VALUE) -> Column:
    """R7 per row: ``struct(num, den)``; batch loss ``0.5 * sum(num)/sum(den)``."""
    m = _d(mask)
    pair = F.zip_with(_d(values), _d(old_values), lambda v, o: F.struct(
        v.alias("v"), F.least(F.greatest(v, o - cliprange_value), o + cliprange_value).alias("c")))
    sq = F.zip_with(pair, _d(returns), lambda p, r: F.greatest((p["v"] - r) * (p["v"] - r),
                                                               (p["c"] - r) * (p["c"] - r)))
    num = F.aggregate(F.zip_with(sq, m, lambda s, k: s * k), F.lit(0.0), lambda a, x: a + x)
    den = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    return F.struct(num.alias("num"), den.alias("den"))


def nth_pad_index(ids: Column, pad_id: int, nth: int = 0, default: Column | None = None) -> Column:
    """0-based index of the ``nth`` (0-based) pad token, else ``default``
    (the sequence length)."""
    pads = F.filter(F.transform(ids, lambda x, i: F.when(x == pad_id, i)), lambda i: i.isNotNull())
    dflt = F.size(ids) if default is None else default
    return F.coalesce(F.get(pads, F.lit(nth)), dflt)


def log_sigmoid(x: Column) -> Column:
    """Numerically stable ``log(sigmoid(x)) = min(x, 0) - ln(1 + exp(-|x|))``."""
    return F.least(x, F.lit(0.0)) - F.log(F.lit(1.0) + F.exp(-F.abs(x)))


def pairwise_loss(chosen_ids: Column, rejected_ids: Column, chosen_reward: Column,
                  rejected_reward: Column, pad_id: int, num_padding_at_beginning: int = 0) -> Column:
    """R8 per pair: divergence index, end index, ``-mean(logsigmoid(c - r))``
    over ``[div, end)`` and the end scores at first-pad - 1. Identical pairs
    use ``end = seq_len``, ``div = end - 1``, ``r_ind = c_ind``. A divergence
    index of 0 raises, as the reference asserts."""
    n = F.size(chosen_ids)
    c_ind = nth_pad_index(chosen_ids, pad_id, num_padding_at_beginning)
    r_pad = nth_pad_index(rejected_ids, pad_id, num_padding_at_beginning)
    diff = F.filter(F.transform(chosen_ids, lambda x, i: F.when(
        ~x.eqNullSafe(F.get(rejected_ids, i)), i)), lambda i: i.isNotNull())
    same = F.size(diff) == 0
    rsize = F.size(rejected_reward)
    end = F.when(same, rsize).otherwise(F.greatest(c_ind, r_pad))
    div = F.when(same, rsize - 1).otherwise(F.get(diff, 0))
    r_ind = F.when(same, c_ind).otherwise(r_pad)
    div = F.when(div > 0, div).otherwise(F.raise_error(F.lit("divergence index must be > 0")))
    # a first difference past both pads leaves no position: the loss is null
    length = F.greatest(end - div, F.lit(0))
    c_tr = F.slice(_d(chosen_reward), div + 1, length)
    r_tr = F.slice(_d(rejected_reward), div + 1, length)
    ls = F.zip_with(c_tr, r_tr, lambda c, r: log_sigmoid(c - r))
    loss = F.try_divide(-F.aggregate(ls, F.lit(0.0), lambda a, x: a + x), F.size(ls).cast("double"))
    return F.struct(div.alias("divergence"), end.alias("end_ind"), loss.alias("loss"),
                    F.get(_d(chosen_reward), c_ind - 1).alias("chosen_end_score"),
                    F.get(_d(rejected_reward), r_ind - 1).alias("rejected_end_score"))


def end_score(ids: Column, values: Column, prompt_length: Column, pad_id: int) -> Column:
    """Value just before the first pad at or after ``prompt_length``
    (sequence end when none)."""
    n = F.size(ids)
    answer = F.slice(ids, prompt_length + 1, n)
    first = nth_pad_index(answer, pad_id, 0, F.lit(-1))
    c_ind = F.when(first >= 0, first + prompt_length).otherwise(n)
    return F.get(_d(values), c_ind - 1)


def valid_answer_len(ids: Column, prompt_length: Column, pad_id: int) -> Column:
    """F5 helper: non-pad tokens after the prompt."""
    answer = F.slice(ids, prompt_length + 1, F.size(ids))
    return F.size(F.filter(answer, lambda x: x != pad_id))
