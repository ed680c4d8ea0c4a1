"""The numeric core of online variational Bayes for LDA, in numpy: one document, many documents, the M-step."""

from __future__ import annotations

import numpy as np

from topicloom.functions.draws import gamma_draws
from topicloom.functions.special import digamma, dirichlet_expectation

#: Added to a word's normaliser, so that an underflow is no division by zero.
FLOOR = 1e-100


def exp_expectation(m: np.ndarray) -> np.ndarray:
    """exp(E[log]) of Dirichlet rows."""
    return np.exp(dirichlet_expectation(m))


def vb_document(counts: np.ndarray, beta: np.ndarray, gamma: np.ndarray, alpha: float, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Variational inference of one document.

    counts: of its n distinct words; beta: K by n, exp(E[log beta]) of those words; gamma: its start, left as it is.
    Returns gamma, the statistics theta_k * n_w / phi_w (K by n, without beta) and the number of passes.
    A document without words has gamma = alpha.
    """
    if not len(counts):
        return np.full(len(gamma), float(alpha)), np.zeros((len(gamma), 0)), 0
    theta = np.exp(digamma(gamma) - digamma(gamma.sum()))
    phi = theta @ beta + FLOOR
    passes = 0
    while passes < max_iter:
        last = gamma
        gamma = theta * (beta @ (counts / phi)) + alpha
        theta = np.exp(digamma(gamma) - digamma(gamma.sum()))
        phi = theta @ beta + FLOOR
        passes += 1
        if np.abs(gamma - last).mean() < tol:
            break
    return gamma, np.outer(theta, counts / phi), passes


def vb_documents(counts: np.ndarray, beta: np.ndarray, doc: np.ndarray, gamma: np.ndarray, alpha: float, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variational inference of many documents at once, each as by vb_document.

    counts, beta (n by K) and doc of their n words, by document; gamma: D by K. Documents that have converged are left
    alone. Returns gamma, the words' statistics theta_k * n_w / phi_w (n by K, without beta), and each document's mean
    absolute change of gamma in its last pass (0 without a pass).
    """
    gamma, change = gamma.copy(), np.zeros(len(gamma))
    sizes = np.bincount(doc, minlength=len(gamma))
    gamma[sizes == 0] = alpha
    expect = lambda g: np.exp(digamma(g) - digamma(g.sum(1))[:, None])
    theta = expect(gamma)
    live = np.flatnonzero(sizes)
    lengths, n, b = sizes[live], counts, np.ascontiguousarray(beta.T)  # K rows: sums along a row are quicker than over many short ones
    for _ in range(max_iter):
        if not len(live):
            break
        starts, own = np.cumsum(lengths) - lengths, theta[live]
        phi = np.einsum("ij,ij->j", np.repeat(np.ascontiguousarray(own.T), lengths, axis=1), b) + FLOOR
        weight = n / phi
        new = own * np.stack([np.add.reduceat(weight * row, starts) for row in b], axis=1) + alpha
        change[live] = np.abs(new - gamma[live]).mean(1)
        moved = change[live] >= tol
        gamma[live], theta[live] = new, expect(new)
        if not moved.all():
            words = np.repeat(moved, lengths)
            live, lengths, n, b = live[moved], lengths[moved], n[words], b[:, words]
    weight = counts / (np.einsum("ij,ij->i", theta[doc], beta) + FLOOR)
    return gamma, theta[doc] * weight[:, None], change


def document_bounds(counts: np.ndarray, beta: np.ndarray, doc: np.ndarray, gamma: np.ndarray, alpha: float) -> np.ndarray:
    """What each of many documents adds to the variational bound. beta: n by K, exp(E[log beta]) of the words, over the whole vocabulary."""
    from topicloom.functions.special import lgamma

    e_theta, k = dirichlet_expectation(gamma), gamma.shape[1]
    phi = np.einsum("ij,ij->i", np.exp(e_theta)[doc], beta) + FLOOR
    prior = ((alpha - gamma) * e_theta).sum(1) + (lgamma(gamma) - lgamma(alpha)).sum(1) + lgamma(alpha * k) - lgamma(gamma.sum(1))
    return np.bincount(doc, counts * np.log(phi), len(gamma)) + prior


def topic_bound(lam: np.ndarray, eta: float) -> float:
    """What the topics (K by V) add to the variational bound."""
    from topicloom.functions.special import lgamma

    return float(((eta - lam) * dirichlet_expectation(lam)).sum() + (lgamma(lam) - lgamma(eta)).sum() + (lgamma(eta * lam.shape[1]) - lgamma(lam.sum(1))).sum())


def per_word_perplexity(documents: float, topics: float, size: int, n_words: int, total_docs: int) -> float:
    """From the bounds of a minibatch of size documents with n_words words; nan without words."""
    if not n_words:
        return float("nan")
    return float(np.exp(-(documents * total_docs / size + topics) * size / (total_docs * n_words)))


def start_gammas(seed: int, doc_ids: np.ndarray, k: int) -> np.ndarray:
    """Draws from Gamma(100, 1/100), a row for each document, that depend on the seed and the document alone."""
    return gamma_draws(seed, 0, doc_ids, k)


def start_gamma(seed: int, doc_id: int, k: int) -> np.ndarray:
    return start_gammas(seed, np.array([doc_id]), k)[0]


def start_weights(seed: int, word_ids: np.ndarray, k: int) -> np.ndarray:
    """Draws from Gamma(100, 1/100), a row for each word, that depend on the seed and the word alone."""
    return gamma_draws(seed, 1, word_ids, k)


def start_lambda(seed: int, k: int, v: int) -> np.ndarray:
    """K by V: the same draws."""
    return start_weights(seed, np.arange(v), k).T.copy()


def learning_rate(tau: float, updates: float, kappa: float) -> float:
    return (tau + updates) ** -kappa


def m_step(lam: np.ndarray, ss: np.ndarray, batch_size: int, *, eta: float, tau: float, kappa: float, total_docs: int, updates: int, compat: str = "local") -> np.ndarray:
    """The next lambda. compat "local" scales eta by the learning rate and counts updates from 0; "distributed" does neither."""
    if not batch_size:
        return lam
    scaled = ss * (total_docs / batch_size)
    if compat == "distributed":
        rho = learning_rate(tau, updates + 1, kappa)
        return (1 - rho) * lam + rho * scaled + eta
    rho = learning_rate(tau, updates, kappa)
    return (1 - rho) * lam + rho * (scaled + eta)


class ScaledLambda:
    """lambda as scale * m + shift, so that a step touches the words of its minibatch alone: what it does to all others alike goes into the two numbers."""

    #: A scale below it is multiplied out.
    LEAST = 1e-60

    def __init__(self, lam: np.ndarray):
        self.m, self.scale, self.shift, self.totals = np.array(lam.T, float, order="C"), 1.0, 0.0, lam.sum(1)

    def rows(self, words: np.ndarray) -> np.ndarray:
        """n by K."""
        return self.scale * self.m[words] + self.shift

    def dense(self) -> np.ndarray:
        """K by V, a copy."""
        out = np.multiply(self.m.T, self.scale, order="C")
        out += self.shift
        return out

    def step(self, words: np.ndarray, ss: np.ndarray, batch_size: int, *, eta: float, tau: float, kappa: float, total_docs: int, updates: int, compat: str = "local") -> None:
        """As m_step, from the statistics (n by K) of the distinct words of a minibatch; those of others are zeros."""
        far = compat == "distributed"
        rho = learning_rate(tau, updates + far, kappa)
        floor, added = eta if far else rho * eta, ss * (rho * total_docs / batch_size)
        if self.scale * (1 - rho) < self.LEAST:
            self.m *= self.scale * (1 - rho)
            self.m += self.shift * (1 - rho)
            self.scale, self.shift = 1.0, 0.0
        else:
            self.scale, self.shift = self.scale * (1 - rho), self.shift * (1 - rho)
        self.shift += floor
        self.m[words] += added / self.scale
        self.totals = (1 - rho) * self.totals + added.sum(0) + floor * len(self.m)


def perplexity_bound(bags: list[tuple[np.ndarray, np.ndarray]], gamma: np.ndarray, lam: np.ndarray, *, alpha: float, eta: float, total_docs: int) -> float:
    """The variational bound of a minibatch (numpy; the dataflow version is in evaluate)."""
    from topicloom.functions.special import lgamma, log_sum_exp

    e_theta, e_beta = dirichlet_expectation(gamma), dirichlet_expectation(lam)
    k, v = lam.shape
    s = sum(float(n @ log_sum_exp(e_theta[d][:, None] + e_beta[:, ids], 0)) for d, (ids, n) in enumerate(bags))
    s += float(((alpha - gamma) * e_theta).sum() + (lgamma(gamma) - lgamma(alpha)).sum() + (lgamma(alpha * k) - lgamma(gamma.sum(1))).sum())
    s *= total_docs / len(bags)
    s += float(((eta - lam) * e_beta).sum() + (lgamma(lam) - lgamma(eta)).sum() + (lgamma(eta * v) - lgamma(lam.sum(1))).sum())
    return s
