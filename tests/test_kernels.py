"""The numpy kernels against known signals and documented values."""

import numpy as np
import pytest

from evoq.functions import kernels as k

SINE = np.sin(2 * np.pi * np.arange(3000) / 100)


@pytest.mark.parametrize("rate", [1000, 1024])
def test_filter_response(rate):
    b, a = k.butterworth_band(4, 4 / (rate / 2), 30 / (rate / 2))
    gain = {}
    for f in (4, 11, 30):
        z = np.exp(-2j * np.pi * f / rate * np.arange(9))
        gain[f] = 20 * np.log10(abs((b @ z) / (a @ z)))
    assert gain[4] == pytest.approx(-3.0103, abs=1e-3)
    assert gain[30] == pytest.approx(-3.0103, abs=1e-3)
    assert gain[11] == pytest.approx(0, abs=1e-3)


def test_zero_phase_keeps_a_sine_in_the_band_and_its_phase():
    t = np.arange(1501) / 1000
    x = np.sin(2 * np.pi * 11 * t)[None]
    y = k.zero_phase(x, 1000, (4, 30), 4)
    assert np.abs(y - x)[0, 400:-400].max() < 0.06
    assert k.zero_phase(x[:, :27], 1000, (4, 30), 4) is None


def test_zero_phase_agrees_with_its_matrix():
    x = np.random.default_rng(1).normal(size=(2, 64))
    columns = k.zero_phase(np.eye(64), 64, (4, 30), 4)
    assert np.allclose(x @ columns, k.zero_phase(x, 64, (4, 30), 4), atol=1e-9)


@pytest.mark.parametrize("n", [500, 501])
def test_analytic_signal(n):
    w = 2 * np.pi * 5 * np.arange(n) / n
    assert np.allclose(k.analytic(np.cos(w)[None])[0], np.exp(1j * w), atol=1e-9)


@pytest.mark.parametrize("length, segment", [(901, 256), (922, 256), (301, 256), (57, 32), (19, 32)])
def test_welch_by_the_definition(length, segment):
    x, fs = np.random.default_rng(2).normal(size=length), 1000.0
    n = min(length, segment)
    step, w = n - n // 2, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    count = (length - n // 2) // step
    power = np.zeros(n // 2 + 1)
    for s in range(count):
        part = x[s * step:s * step + n]
        part = (part - part.mean()) * w
        for f in range(n // 2 + 1):
            z = np.sum(part * np.exp(-2j * np.pi * f * np.arange(n) / n))
            power[f] += abs(z) ** 2 / (fs * np.sum(w ** 2)) * (1 if f == 0 or 2 * f == n else 2) / count
    assert np.allclose(k.welch_power(x[None], fs, segment)[0], power, rtol=1e-9, atol=1e-18)


def test_sample_entropy_of_a_sine():
    short, long = k.template_matches(SINE[None], 0.2)
    assert -np.log(long / short)[0] == pytest.approx(0.1633, abs=5e-5)


def slope(x, sizes):
    return np.polyfit(np.log(sizes), np.log(k.box_fluctuation(x[None], sizes)[0]), 1)[0]


def test_fluctuation_slopes():
    sizes = k.box_sizes(3000)
    assert slope(SINE, sizes) == pytest.approx(1.5848, abs=5e-5)
    noise = np.random.default_rng(3).normal(size=20000)
    assert slope(noise, k.box_sizes(20000)) == pytest.approx(0.5, abs=0.05)


def test_box_sizes():
    assert k.box_sizes(901) == [4, 5, 6, 8, 9, 11, 14, 17, 20, 24, 29, 35, 42, 51, 61, 73, 88]
    assert k.box_sizes(57) == [4]
