import datetime as dt

import pytest

from liftlens.params import Params, parse_id_list


def test_parse_id_list_tolerates_spaces():
    assert parse_id_list(" 1, 2 ,3", required=True) == (1, 2, 3)


def test_empty_required_list_raises():
    with pytest.raises(ValueError):
        parse_id_list("", required=True)


def test_empty_optional_list_means_no_filter():
    assert parse_id_list("", required=False) == ()
    assert parse_id_list(None, required=False) == ()


def test_from_text_builds_typed_values():
    p = Params.from_text("2020-01-01", "2020-01-31", "5,6", "a", "b", "7")
    assert p.start_date == dt.date(2020, 1, 1)
    assert p.order_ids == (5, 6)
    assert p.line_item_ids == (7,)
    assert (p.model1, p.model2) == ("a", "b")


def test_bad_window_rejected():
    with pytest.raises(ValueError):
        Params(dt.date(2020, 2, 1), dt.date(2020, 1, 1), (1,), ("a",))


def test_bad_date_text_rejected():
    with pytest.raises(ValueError):
        Params.from_text("2020-13-01", "2020-01-31", "1", "a", "b")


def test_scale_settings_size_partitions_by_volume():
    from liftlens.session import scale_settings

    big = scale_settings(100 * 1024**4, cores=8000)  # 100 TB over 1000 executors x 8 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    small = scale_settings(10 * 1024**2, cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24
