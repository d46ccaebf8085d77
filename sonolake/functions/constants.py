"""Fixed values of the scoring semantics."""

#: Verdicts by least score, worst first, with the confidence text of each.
VERDICTS = [
    (86, "FAKE_CERTAIN", "❌ Transcoding confirmé avec certitude"),
    (61, "SUSPICIOUS", "⚠️  Probable transcoding, vérification recommandée"),
    (31, "WARNING", "⚡ Anomalies détectées, peut être légitime"),
    (0, "AUTHENTIC", "✅ Fichier authentique"),
]
#: Report buckets by least score.
BUCKETS = [(80, "fake"), (50, "suspect"), (30, "probably_authentic"), (0, "authentic")]
#: Cutoff ranges [low, high) in Hz and the MP3 bitrate in kbps that leaves them.
SIGNATURES = [(19500, 21500, 320), (18500, 19500, 256), (17500, 18500, 224), (16500, 17500, 192), (15500, 16500, 160), (10000, 15500, 128)]
#: Container bitrates in kbps, ends included, that go with a source bitrate.
CONTAINERS = {128: (400, 550), 160: (450, 650), 192: (500, 750), 224: (550, 800), 256: (600, 850), 320: (700, 1050)}
#: Least full-quality cutoff in Hz by sample rate; other rates take 0.45 times the rate.
CUTOFFS = {44100: 20000, 48000: 22000, 88200: 40000, 96000: 44000, 176400: 80000, 192000: 88000}
#: Lossy or non-FLAC audio extensions, in reporting order.
OTHER_AUDIO = ["mp3", "m4a", "aac", "ogg", "wma", "opus", "ape"]
#: Parts of decoder messages that a retry may mend.
TEMPORARY = ["lost sync", "decoder error", "sync error", "invalid frame", "unexpected end", "unknown error"]
#: Ripping programs by what their logs begin with, best evidence first.
RIPPERS = [("EAC", ["Exact Audio Copy", "EAC extraction logfile"]), ("XLD", ["X Lossless Decoder", "XLD extraction logfile"]), ("CUERipper", ["CUERipper"]), ("Audiochecker", ["AUDIOCHECKER"])]
#: Source of an entry whose log checked single tracks, and the status that such a track needs.
CHECKED_SOURCE, CHECKED_STATUS = "audiochecker_cdda100", "CDDA (100%)"
#: What the text report advises, by the count that asks for it, and the diagnostic report's heading.
ADVICE = [("Delete Fakes", "fake"), ("Check Suspicious", "suspect"), ("Repair Duration", "duration_issues_critical")]
DIAGNOSTIC_HEAD = "DIAGNOSTIC REPORT - File Analysis Issues"
#: Transcoding targets (label, encoder, extension, bitrate, further arguments).
CODECS = [
    ("mp3_128", "libmp3lame", "mp3", "128k", ""), ("mp3_192", "libmp3lame", "mp3", "192k", ""), ("mp3_256", "libmp3lame", "mp3", "256k", ""), ("mp3_320", "libmp3lame", "mp3", "320k", ""),
    ("mp3_v0", "libmp3lame", "mp3", "0", "-q:a 0"), ("mp3_v2", "libmp3lame", "mp3", "0", "-q:a 2"), ("aac_192", "aac", "m4a", "192k", ""), ("aac_256", "aac", "m4a", "256k", ""),
    ("opus_128", "libopus", "opus", "128k", ""), ("vorbis_q5", "libvorbis", "ogg", "0", "-q:a 5"),
]
#: Issue types that are critical, and the difference of durations in samples that is tolerated.
CRITICAL_ISSUES = ["read_failed", "corrupted"]
DURATION_TOLERANCE = 588
#: Texts of the rules' reasons, in output format; numbers come as text.
REASONS = {
    "r1": "Constant MP3 bitrate detected (Spectral): %s kbps",
    "r2": "R2: Cutoff %s Hz < %s Hz (+%spts)",
    "r3": "R3: Source %s kbps vs conteneur %s kbps",
    "r4": "R4: 24-bit avec bitrate source %s kbps et cutoff %s Hz (upscale suspect)",
    "r5": "Authentic high variable bitrate: %s kbps, variance %s kbps (-40 pts)",
    "r6": "R6: Haute qualité confirmée (bitrate %s kbps, cutoff %s Hz, variance %s kbps) → Authentique (-30pts)",
    "r7_dither": "R7-P1: Dither artificiel détecté dans les silences (Ratio %s > 0.3) (+50pts)",
    "r7_clean": "R7-P1: Silence naturel propre (Ratio %s < 0.15) (-50pts)",
    "r7_vinyl": "R7-P2: Bruit vinyle détecté (énergie=%sdB, autocorr=%s) (-40pts)",
    "r7_clicks": "R7-P3: Clicks vinyle détectés (%s clicks/min) (-10pts)",
    "r7_none": "R7-P2: Pas de bruit au-dessus du cutoff (énergie=%sdB) -> Upsampling digital suspect (+20pts)",
    "r7_pattern": "R7-P2: Bruit avec pattern détecté (autocorr=%s) -> Incertain (0pts)",
    "r8_close": "Très proche limite",
    "r8_likely": "Probablement authentique",
    "r8": "R8: Cutoff à %s%% de Nyquist (%s/%s Hz) → %s (%spts)",
    "r8_mp3": "R8: Cutoff à %s%% de Nyquist (%s/%s Hz) → %s (%spts, MP3 signature mais silence authentique)",
    "r8_reduced": "R8: Cutoff à %s%% de Nyquist (%s/%s Hz) → Bonus réduit (MP3 signature + zone grise) (-15pts)",
    "r8_cancelled": "R8: Bonus Nyquist annulé (MP3 signature %s kbps + dither suspect %s > 0.2)",
    "r9_preecho": "R9A: Pré-echo détecté (%s%% transitoires affectées) (+15pts)",
    "r9_preecho_some": "R9A: Pré-echo modéré (%s%% transitoires) (+10pts)",
    "r9_aliasing": "R9B: Aliasing HF fort (corr=%s) (+15pts)",
    "r9_aliasing_some": "R9B: Aliasing HF modéré (corr=%s) (+10pts)",
    "r9_pattern": "R9C: Pattern de bruit MP3 détecté (+10pts)",
    "r10_spread": "R10: Cutoff variance élevée (%s Hz) -> Mastering dynamique probable (-20pts)",
    "r10_local": "R10: Anomalie locale détectée (1 seul segment problématique) -> Artefact probable (-30pts)",
    "r10_whole": "R10: Anomalie cohérente sur tout le fichier (Variance %s Hz)",
    "r11_hiss": "R11A: Bruit de bande détecté (%s dB, aléatoire) (Prob. Cassette)",
    "r11_natural": "R11B: Roll-off naturel cassette (%s dB/kHz) (Prob. Cassette)",
    "r11_sharp": "R11B: Coupure nette numérique (%s dB/kHz) (Prob. Numérique)",
    "r11_no_mp3": "R11C: Aucun pattern MP3 détecté (compatible cassette) (Prob. Cassette)",
    "r11_flutter": "R11D: Variation cutoff naturelle (%s Hz, wow/flutter) (Prob. Cassette)",
    "r11_stable": "R11D: Cutoff très stable (%s Hz, suspect digital) (Prob. Numérique)",
    "r11_bonus": "R11: Source cassette audio authentique (Bonus -40pts)",
    "r12": "R12: CNN classifier flags transcode (p=%s, confidence=%s, +%spts)",
    "fast_fake": "⚡ Analyse rapide : FAKE_CERTAIN détecté sans règles coûteuses",
    "fast_authentic": "⚡ Analyse rapide : AUTHENTIC détecté sans règles coûteuses",
    "none": "No anomaly detected",
    "separator": " | ",
}
#: Defaults of an analysis (seconds of a sample and their range, files of a checkpoint) and the job's report formats.
SAMPLE_SECONDS = 30.0
SAMPLE_RANGE = (5.0, 120.0)
CHECKPOINT_FILES = 50
FORMATS = ["text", "json"]
#: Tries to read a file, seconds before the second one, and their growth.
READ_TRIES, READ_DELAY, READ_BACKOFF = 5, 0.2, 2.0
