"""Made-up sound with known answers, for tests; the queries themselves measure the recordings of ``plans.recordings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import audio as AU
from undula.sources.pcm import synthetic

TAU = 6.283185307179586


def tone(t, hz: float, level: float = 0.2):
    return F.sin(t * F.lit(TAU * hz)) * F.lit(level)


def hiss(t, seed: int, level: float = 0.02):
    """Even noise from a hash of the time."""
    return (F.pmod(F.xxhash64(t, F.lit(seed)), F.lit(2_000_003)) / F.lit(1_000_001.5) - 1.0) * F.lit(level)


def clicks(spark: SparkSession) -> DataFrame:
    times = (1.0, 2.5, 3.25, 5.0, 6.75)

    def sound(t):
        hit = F.lit(0.0)
        for at in times:
            hit = hit + F.when(F.abs(t - at) < 0.00004, 0.9).otherwise(0.0)
        return [hiss(t, 7, 0.01) + tone(t, 300, 0.15) + hit]

    return synthetic(spark, {"clicks": 8.0, "quiet": 8.0}, {"clicks": sound, "quiet": lambda t: [hiss(t, 8, 0.01) + tone(t, 300, 0.15)]}, sr=44100, chunk=16384)


def impulse_scan(spark, sf):
    return AU.impulse_scan(clicks(spark), 44100, 16384)[1]


def impulse_events(spark, sf):
    return AU.strongest_events(AU.impulse_scan(clicks(spark), 44100, 16384)[0])


def lowfreq_scan(spark, sf):
    hum = lambda f: lambda t: [hiss(t, 3, 0.0005) + tone(t, f, 0.02) + tone(t, 2 * f, 0.008) + tone(t, 3 * f, 0.012)]
    sound = {"hum50": hum(50), "hum60": hum(60), "clean": lambda t: [hiss(t, 4, 0.05)], "rumble": lambda t: [hiss(t, 5, 0.002) + tone(t, 8, 0.5) + tone(t, 1000, 0.1)]}
    return AU.lowfreq_scan(synthetic(spark, dict.fromkeys(sound, 20.0), sound, sr=4000, chunk=16384), 4000, 16384)


def wow_flutter(spark, sf):
    """A 315 Hz tone whose frequency varies by 0.1 % (RMS) at 0.55 Hz, and a steady one."""

    def varied(t):
        depth = 0.001 * 2**0.5 * 315 / 0.55
        return [F.sin(t * F.lit(TAU * 315) - F.lit(depth) * F.cos(t * F.lit(TAU * 0.55))) * 0.5]

    sound = {"wow": varied, "steady": lambda t: [tone(t, 3150, 0.5)], "slow": lambda t: [tone(t, 312, 0.5)], "noise": lambda t: [hiss(t, 1, 0.3)]}
    return AU.wow_flutter(synthetic(spark, dict.fromkeys(sound, 12.0), sound, sr=48000, chunk=12000), 48000, 12000)


def ladder(spark: SparkSession) -> DataFrame:
    hz = (30.0, 60.0, 125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 12000.0)

    def sound(t):
        k = F.floor(t / 2.5)
        at = F.element_at(F.array(*map(F.lit, hz)), F.least(k + 1, F.lit(len(hz))).cast("int"))
        on = F.when(t - k * 2.5 < 2.0, 1.0).otherwise(0.0)
        left = F.sin(t * at * F.lit(TAU)) * on * 0.3 + hiss(t, 9, 0.0001)
        return [left, left * F.lit(0.0316)]

    return synthetic(spark, {"ladder": 25.0}, {"ladder": sound}, sr=48000, chunk=12000)


def tone_sweep(spark, sf):
    response, apart = AU.tone_sweep(ladder(spark), 48000, 12000)
    return response.join(apart.select("file", "channel_separation_db", "channel_separation_min_db", "verdict_key"), "file")


def tone_steps(spark, sf):
    return AU.tone_steps(ladder(spark), 48000, 12000)


def loudness_r128(spark, sf):
    """A 997 Hz sine of full scale in one channel is defined as -3.01 LUFS; one 20 dB lower is -23.01."""
    sound = {"full": lambda t: [tone(t, 997, 1.0)], "low": lambda t: [tone(t, 997, 0.1)]}
    return AU.loudness(synthetic(spark, dict.fromkeys(sound, 8.0), sound, sr=48000, chunk=24000), 24000)


def band_edge_audio(spark, sf):
    """Noise of many tones up to 3 kHz only, and up to the top, at 8 kHz."""

    def upto(top):
        def sound(t):
            x = hiss(t, 2, 0.0001)
            for k in range(1, int(top / 125)):
                x = x + tone(t + 0.013 * k * k, 125.0 * k + (k * 7 % 11), 0.01)
            return [x]

        return sound

    chunks = synthetic(spark, {"cut": 3.0, "full": 3.0}, {"cut": upto(3000), "full": upto(4000)}, sr=8000, chunk=8192)
    codecs = spark.createDataFrame([("cut", "flac"), ("full", "flac")], "file string, codec string")
    from undula.operators import frames as FR
    from undula.operators import spectrum as SP

    rows = FR.bins_of(AU.stft(FR.hop_frames(AU.mixed(chunks), 1024, 512, 8192)))
    return SP.band_analysis(rows, codecs, 8000, 1024, min_hz=1000.0)
