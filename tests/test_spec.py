import numpy as np
import pytest

from sparkchirp.spec import MESSAGES, Code, Flag, ObservationSpec, SearchError, adaptive_dms, linear_dms, message

BENCH = ObservationSpec(1024, 64e-6, 1581.0, -0.390625)


def test_documented_delays():
    assert BENCH.max_delay(linear_dms(0.0, 2.0, 100)) == 4063
    assert BENCH.max_delay(linear_dms(0.0, 2.0, 1024)) == 41980


def test_adaptive_list_of_the_pulse_test():
    spec = ObservationSpec(1024, 250e-6, 1581.0, -100.0 / 1024)
    dms = adaptive_dms(spec, 2.0, 100.0, 4.0, 1.25)
    assert len(dms) == 32 and spec.max_delay(dms) == 95
    assert dms[:3] == pytest.approx([2.0, 5.24339, 8.486762], rel=1e-6) and dms[-1] == pytest.approx(102.66167, rel=1e-6)


def test_adaptive_list_of_the_long_test():
    spec = ObservationSpec(3072, 1e-4, 169.589996337891, -30.7199914522957 / 3072)
    dms = adaptive_dms(spec, 20.0, 60.0, 4.0, 1.25)
    assert len(dms) == 1118 and dms[-1] == pytest.approx(60.028095, rel=1e-6) and spec.max_delay(dms) == 42542


def test_step_sign_is_normalised():
    up, down = ObservationSpec(64, 6.4e-3, 1581.0, 6.25), ObservationSpec(64, 6.4e-3, 1581.0, -6.25)
    assert up == down and np.array_equal(up.delays(), down.delays())


def test_limits_and_errors():
    for n in (0, 8193):
        with pytest.raises(SearchError) as e:
            ObservationSpec(n, 1e-3, 1500.0, -1.0)
        assert e.value.code == Code.NCHANS_EXCEEDS_LIMIT
    with pytest.raises(SearchError) as e:
        BENCH.max_delay([])
    assert e.value.code == Code.NO_DM_LIST_SET
    assert BENCH.with_killmask([2] * 1024).killmask == (1,) * 1024
    assert len(MESSAGES) == len(Code) and message(99) == "Invalid error code"
    assert Flag.HOST_POINTERS | Flag.DEVICE_POINTERS == 6 and Flag.ASYNC == 16


def test_delay_uses_the_largest_trial_and_unknown_trials_have_none():
    assert BENCH.max_delay([198.0, 0.0]) == 4063
    assert BENCH.dm_delay([0.0, 198.0], 1) == 4063 and BENCH.dm_delay([0.0], 5) == 0


def test_shift_never_exceeds_the_rounded_delay():
    dms = np.linspace(0, 500, 997)
    assert (BENCH.shifts(dms)[:, -1] <= [BENCH.dm_delay(list(dms), i) for i in range(len(dms))]).all()
