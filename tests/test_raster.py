import struct
import zlib

import numpy as np
import pytest

from tallyweave.operators import raster as rs

SCHEMA = "image_id long, h int, w int, c int, px array<float>"


def frame(spark, *pictures):
    return spark.createDataFrame([(i, *p.shape, [float(v) for v in p.ravel()]) for i, p in enumerate(pictures)], SCHEMA)


def arrays(df):
    return {r.image_id: np.array(r.px).reshape(r.h, r.w, r.c) for r in df.collect()}


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(1)
    return frame(spark, *[rng.integers(0, 256, (12, 10, 3)).astype(float) for _ in range(40)])


def only(**switches):
    return rs.Augmentation(**switches)


def test_flips(spark, pictures):
    before = arrays(pictures)
    for name, axis in (("horizontal_flip", 1), ("vertical_flip", 0)):
        once = arrays(rs.augment(pictures, only(**{name: True})))
        turned = sum(not np.array_equal(once[i], p) for i, p in before.items())
        assert 8 < turned < 32
        assert all(np.array_equal(once[i], p) or np.array_equal(once[i], np.flip(p, axis)) for i, p in before.items())
        # the same draw turns the same pictures back
        twice = arrays(rs.augment(rs.augment(pictures, only(**{name: True})).drop("epoch"), only(**{name: True})))
        assert all(np.array_equal(twice[i], p) for i, p in before.items())


def test_switches(pictures):
    off = arrays(rs.augment(pictures, only(data_augmentation=False, grayscale=True, cutout=True)))
    none = arrays(rs.augment(pictures, only()))
    assert all(np.array_equal(off[i], p) and np.array_equal(none[i], p) for i, p in arrays(pictures).items())
    gray = arrays(rs.augment(pictures, only(grayscale=True)))
    assert all(np.allclose(p[..., 0], p[..., 1]) for p in gray.values())


def test_everything_is_reproducible(pictures):
    flags = dict.fromkeys(
        ["random_grayscale", "horizontal_flip", "random_rotation", "zoom", "brightness_contrast", "random_crop", "gaussian_noise", "blur", "cutout"], True
    )
    config = only(**flags, clip_max=255.0, crop_pixels=3, cutout_size=4)
    first = {(r.image_id, r.epoch): r.px for r in rs.augment(pictures, config, epochs=2).collect()}
    again = {(r.image_id, r.epoch): r.px for r in rs.augment(pictures.repartition(13), config, epochs=2).collect()}
    assert first == again and len(first) == 80
    assert any(first[i, 1] != first[i, 2] for i in range(40))


def test_rotation_and_zoom_keep_flat_pictures_and_ranges(spark, pictures):
    flat = frame(spark, np.full((9, 9, 3), 77.0))
    assert np.allclose(arrays(rs.augment(flat, only(random_rotation=True, zoom=True, random_crop=True, blur=True)))[0], 77.0, atol=1e-3)
    for p in arrays(rs.augment(pictures, only(random_rotation=True, zoom=True))).values():
        assert p.min() >= 0 and p.max() <= 255


def test_kernels():
    px = np.arange(2 * 5 * 4 * 1, dtype=float).reshape(2, 5, 4, 1)
    zero = np.zeros(2)
    assert np.allclose(rs._rotate(px, zero), px)
    assert np.allclose(rs._zoom(px, zero, zero), px)
    assert np.allclose(rs._rotate(px[:, :4], zero + np.pi), px[:, 3::-1, ::-1], atol=1e-9)
    assert np.allclose(rs._reflect(np.array([-1.0, -2.0, 5.0, 4.2, 2.0]), 5), [0, 1, 4, 4, 2])
    assert np.array_equal(rs._bilinear(px, 5, 4), px) and np.array_equal(rs._nearest(px, 5, 4), px)
    assert np.allclose(rs._crop(px, zero, zero, 0), px)
    one_row = np.array([[[[1.0], [3.0]]]])
    assert np.allclose(rs._bilinear(one_row, 1, 4).ravel(), [1, 1.5, 2.5, 3])
    assert np.array_equal(rs._nearest(one_row, 1, 4).ravel(), [1, 1, 3, 3])


def test_clip_follows_the_flag(pictures):
    assert max(p.max() for p in arrays(rs.augment(pictures, only(brightness_contrast=True))).values()) == 1
    assert max(p.max() for p in arrays(rs.augment(pictures, only(brightness_contrast=True, clip_max=255.0))).values()) > 100


def test_cutout_and_noise(spark):
    flat = frame(spark, *[np.full((16, 16, 1), 9.0) for _ in range(30)])
    holes = [int((p == 0).sum()) for p in arrays(rs.augment(flat, only(cutout=True, cutout_size=6))).values()]
    assert max(holes) == 36 and min(holes) >= 9
    noise = np.stack([p - 9.0 for p in arrays(rs.augment(flat, only(gaussian_noise=True))).values()])
    assert abs(noise.std() - 0.02) < 0.002 and abs(noise.mean()) < 0.001


def test_noise_is_normal_and_without_pattern():
    rng = np.random.default_rng(5)
    drawn = rs._noise(np.floor(rng.random(400) * 2**32) / 2**32, (16, 16, 3))
    flat = drawn.reshape(400, -1)
    assert abs(flat.mean()) < 0.01 and abs(flat.std() - 1) < 0.01 and abs((flat**3).mean()) < 0.03 and abs((flat**4).mean() - 3) < 0.1
    assert abs((np.abs(flat) < 1.96).mean() - 0.95) < 0.002 and np.isfinite(flat).all()
    # no place follows its neighbour, the next row or another picture
    for a, b in ((flat[:, 1:], flat[:, :-1]), (flat[:, 48:], flat[:, :-48]), (flat[1:], flat[:-1])):
        assert abs((a * b).mean()) < 0.01
    assert len(np.unique(flat)) > 0.99 * flat.size


def test_alpha(spark):
    rgba = np.array([[[10, 20, 30, 255], [10, 20, 30, 0], [10, 20, 30, 128]]], float)
    assert arrays(rs.flatten_alpha(frame(spark, rgba)))[0].tolist() == [[[10, 20, 30], [255, 255, 255], [132, 137, 142]]]
    gray = arrays(rs.flatten_alpha(frame(spark, np.array([[[7.0]]]))))[0]
    assert gray.tolist() == [[[7, 7, 7]]]


def test_saliency_of_a_constant_map_is_zero(spark):
    got = arrays(rs.saliency_edges(frame(spark, np.full((4, 4, 1), 3.0), np.arange(16.0).reshape(4, 4, 1))))
    assert np.all(got[0] == 0)
    assert got[1].min() == 0 and got[1].max() == 1


def test_mixed_shapes_in_one_batch(spark):
    got = arrays(rs.resize_rescale(frame(spark, np.ones((2, 3, 1)), np.ones((5, 4, 3)), np.ones((2, 3, 1))).coalesce(1), 4))
    assert [got[i].shape for i in range(3)] == [(4, 4, 1), (4, 4, 3), (4, 4, 1)]
    assert np.allclose(got[1], 1 / 255)


def png(path, pixels):
    h, w, c = pixels.shape
    raw = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(h))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_reading_pictures(spark, tmp_path):
    (tmp_path / "my class").mkdir()
    rgb = np.arange(2 * 3 * 3).reshape(2, 3, 3)
    rgba = np.array([[[10, 20, 30, 128]]])
    png(tmp_path / "my class" / "rgb.png", rgb)
    png(tmp_path / "my class" / "rgba.png", rgba)
    got = {r.path.rsplit("/", 1)[1]: r for r in rs.read_images(spark, str(tmp_path)).collect()}
    assert got["rgb.png"].label == "my class"
    assert np.array_equal(np.array(got["rgb.png"].px).reshape(2, 3, 3), rgb)
    assert list(got["rgba.png"].px) == [10, 20, 30, 128]


def test_unreadable_pictures_are_listed(spark, tmp_path):
    for folder in ("c++", "b/sub"):
        (tmp_path / folder).mkdir(parents=True)
    png(tmp_path / "c++" / "a b%.png", np.zeros((1, 1, 3), int))
    png(tmp_path / "b" / "sub" / "deep.png", np.zeros((1, 1, 1), int))
    (tmp_path / "c++" / "torn.png").write_bytes(b"\x89PNG\r\n")
    (tmp_path / "top.png").write_bytes(b"no picture")
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert sorted((name(r), r.label) for r in rs.read_images(spark, str(tmp_path)).collect()) == [("a b%.png", "c++"), ("deep.png", "b")]
    lost = rs.unreadable_images(spark, str(tmp_path)).collect()
    assert sorted((name(r), r.label, r.reason) for r in lost) == [("top.png", None, "not a readable image"), ("torn.png", "c++", "not a readable image")]
