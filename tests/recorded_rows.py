"""Rows of literal cases that SQL cannot work out, as recorded and read through: they hold results against change only."""

from __future__ import annotations



def values(columns: str, kinds: tuple[str, ...], rows: tuple) -> str:
    """SELECT of literal rows, the kinds of columns given by the first."""
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    first = [f"CAST({cell(x)} AS {k})" for x, k in zip(rows[0], kinds)]
    body = ["(" + ", ".join(first) + ")"] + ["(" + ", ".join(map(cell, r)) + ")" for r in rows[1:]]
    return f"SELECT * FROM (VALUES {', '.join(body)}) AS v({columns})"


ORACLES = {
    "verse_sounds": values(
        'chapter, verse, sounds',
        ('INTEGER', 'INTEGER', 'VARCHAR'),
        (
            (1, 1, 'b i s m i l l a h i r r a ħ m a aː n i r r a ħ i iː m i'),
            (1, 2, 'ʔ a l ħ a m d u l i l l a h i r a b b i l ʕ a aː l a m i iː n a'),
            (1, 5, 'ʔ i j a aː k a n a ʕ b u d u w a ʔ i j a aː k a n a s t a ʕ i iː n u'),
            (2, 1, 'ʔ a l i f l aː m m iː m'),
            (112, 1, 'q u l h u w a l l a h u ʔ a ħ a d u n'),
            (112, 3, 'l a m j a l i d w a l a m j u uː l a d'),
            (113, 1, 'q u l ʔ a ʕ u uː ð u b i r a b b i l f a l a q i'),
        ),
    ),
    "verse_rules": values(
        'chapter, verse, annotated',
        ('INTEGER', 'INTEGER', 'VARCHAR'),
        (
            (1, 1, 'b i s m i l l a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] h i r r a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] ħ m a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] aː[madd_tabii] n i r r a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] ħ i iː[madd_arid_lissukun] m i'),
            (1, 2, 'ʔ a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] l ħ a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] m[idhhar_shafawi] d u l i l l a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] h i r a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] b[qalqalah_with_shaddah] b i l ʕ a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] aː[madd_tabii] l a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] m i iː[madd_arid_lissukun] n a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel]'),
            (1, 5, 'ʔ i j a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] aː[madd_tabii] k a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] n a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] ʕ b u d u w a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] ʔ i j a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] aː[madd_tabii] k a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] n a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] s t a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] ʕ i iː[madd_arid_lissukun] n u'),
            (2, 1, 'ʔ a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] l i f l aː[madd_lazim,madd_lazim_kalimi] m[ghunnah_mushaddadah_meem,idgham_shafawi_meem] m[ghunnah] iː[madd_arid_lissukun,madd_lazim] m'),
            (112, 1, 'q u l h u w a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] l l a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] h u ʔ a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] ħ a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] d[qalqalah_major] u n'),
            (112, 3, 'l a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] m[idhhar_shafawi] j a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] l i d[qalqalah_major,qalqalah_non_emphatic] w a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] l a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] m[idhhar_shafawi] j u uː[madd_tabii] l a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] d[qalqalah_major]'),
            (113, 1, 'q u l ʔ a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] ʕ u uː[madd_tabii] ð u b i r a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] b[qalqalah_with_shaddah] b i l f a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel] l a[cross_word_emphasis_continuation,emphasis_blocking_by_front_vowel,vowel_backing_before_emphatic_short] q[qalqalah_emphatic,qalqalah_major] i'),
        ),
    ),
    "verse_durations": values(
        'chapter, verse, n_sounds, expected_ms',
        ('INTEGER', 'INTEGER', 'BIGINT', 'DOUBLE'),
        (
            (1, 1, 27, 3585.0),
            (1, 2, 31, 3945.0),
            (1, 5, 33, 4865.0),
            (2, 1, 11, 20276.0),
            (112, 1, 19, 1856.0),
            (112, 3, 19, 2580.0),
            (113, 1, 24, 3035.0),
        ),
    ),
    "verse_dictionary": values(
        'word, phones',
        ('VARCHAR', 'VARCHAR'),
        (
            ('أَحَدٌ', '< a H a d u n'),
            ('أَعُوذُ', '< a E u uu z u'),
            ('إِيَّاكَ', '< i j a aa k a'),
            ('الٓمٓ', '< a l i f l aa m m ii m'),
            ('بِرَبِّ', 'b i r a b b i'),
            ('بِسْمِ', 'b i s m i'),
            ('رَبِّ', 'r a b b i'),
            ('قُلْ', 'q u l'),
            ('لَمْ', 'l a m'),
            ('لِلَّهِ', 'l i l l a h i'),
            ('نَسْتَعِينُ', 'n a s t a E i ii n u'),
            ('نَعْبُدُ', 'n a E b u d u'),
            ('هُوَ', 'h u w a'),
            ('وَإِيَّاكَ', 'w a < i j a aa k a'),
            ('وَلَمْ', 'w a l a m'),
            ('يَلِدْ', 'j a l i d'),
            ('يُولَدْ', 'j u uu l a d'),
            ('ٱلرَّحِيمِ', 'r r a H i ii m i'),
            ('ٱلرَّحْمَٰنِ', 'r r a H m a aa n i'),
            ('ٱللَّهُ', 'l l a h u'),
            ('ٱللَّهِ', 'l l a h i'),
            ('ٱلْحَمْدُ', '< a l H a m d u'),
            ('ٱلْعَٰلَمِينَ', 'l E a aa l a m i ii n a'),
            ('ٱلْفَلَقِ', 'l f a l a q i'),
        ),
    ),
    "verse_targets": values(
        'chapter, verse, priority, error, severity, n, expected_ms',
        ('INTEGER', 'INTEGER', 'DOUBLE', 'VARCHAR', 'VARCHAR', 'BIGINT', 'DOUBLE'),
        (
            (1, 1, 0.7, 'duration_mismatch', 'minor', 21, 1985.0),
            (1, 1, 1.0, 'general_error', 'major', 4, 400.0),
            (1, 1, 1.0, 'madd_error', 'major', 2, 1200.0),
            (1, 2, 0.7, 'duration_mismatch', 'minor', 20, 1790.0),
            (1, 2, 1.0, 'general_error', 'major', 7, 795.0),
            (1, 2, 1.0, 'madd_error', 'major', 2, 1200.0),
            (1, 2, 1.0, 'noon_meem_sakinah_error', 'major', 1, 80.0),
            (1, 2, 1.0, 'qalqalah_error', 'major', 1, 80.0),
            (1, 5, 0.7, 'duration_mismatch', 'minor', 22, 2005.0),
            (1, 5, 1.0, 'general_error', 'major', 8, 860.0),
            (1, 5, 1.0, 'madd_error', 'major', 3, 2000.0),
            (2, 1, 0.7, 'duration_mismatch', 'minor', 6, 576.0),
            (2, 1, 1.0, 'general_error', 'major', 3, 11700.0),
            (2, 1, 1.0, 'madd_error', 'major', 1, 7200.0),
            (2, 1, 1.0, 'noon_meem_sakinah_error', 'major', 1, 800.0),
            (112, 1, 0.7, 'duration_mismatch', 'minor', 14, 1330.0),
            (112, 1, 1.0, 'general_error', 'major', 4, 430.0),
            (112, 1, 1.0, 'qalqalah_error', 'major', 1, 96.0),
            (112, 3, 0.7, 'duration_mismatch', 'minor', 9, 760.0),
            (112, 3, 1.0, 'general_error', 'major', 5, 500.0),
            (112, 3, 1.0, 'madd_error', 'major', 1, 800.0),
            (112, 3, 1.0, 'noon_meem_sakinah_error', 'major', 2, 208.0),
            (112, 3, 1.0, 'qalqalah_error', 'major', 2, 312.0),
            (113, 1, 0.7, 'duration_mismatch', 'minor', 17, 1659.0),
            (113, 1, 1.0, 'general_error', 'major', 4, 400.0),
            (113, 1, 1.0, 'madd_error', 'major', 1, 800.0),
            (113, 1, 1.0, 'qalqalah_error', 'major', 2, 176.0),
        ),
    ),
    "long_vowels": values(
        'pos, rule, effective, status, severity, expected, actual',
        ('INTEGER', 'VARCHAR', 'VARCHAR', 'VARCHAR', 'VARCHAR', 'DOUBLE', 'DOUBLE'),
        (
            (0, 'madd_tabii', 'madd_tabii', 'assessed', None, 2.0, 2.0),
            (1, 'madd_tabii', 'madd_tabii', 'assessed', 'style', 2.0, 3.0),
            (2, 'madd_tabii', 'madd_tabii', 'assessed', 'style', 2.0, 1.1),
            (3, 'madd_tabii', 'madd_tabii', 'skipped', None, 2.0, 0.7),
            (4, 'madd_muttasil', 'madd_muttasil', 'assessed', 'major', 4.75, 2.6),
            (5, 'madd_muttasil', 'madd_muttasil', 'skipped', None, 4.75, 3.0),
            (6, 'madd_lazim_kalimi', 'madd_lazim_kalimi', 'assessed', 'style', 6.0, 4.8),
            (8, 'madd_muttasil', 'madd_muttasil', 'skipped', None, 4.75, 3.2),
            (9, 'madd_tabii', 'madd_arid_lissukun', 'assessed', 'style', 4.0, 7.0),
            (10, 'madd_muttasil', 'madd_muttasil', 'assessed', 'style', 4.75, 2.5),
            (12, 'madd_munfasil', 'madd_munfasil', 'assessed', 'style', 3.5, 1.4),
        ),
    ),
    "allocated_words": values(
        'file_id, segment, "offset", duration, first_word, n_words',
        ('VARCHAR', 'INTEGER', 'DOUBLE', 'DOUBLE', 'INTEGER', 'INTEGER'),
        (
            ('a', 1, 0.0, 24.5, 0, 5),
            ('a', 2, 24.5, 25.5, 5, 5),
            ('b', 1, 0.0, 5.0, 0, 3),
            ('c', 1, 0.0, 20.5, 0, 1),
            ('c', 2, 20.5, 29.5, 1, 2),
            ('c', 3, 50.0, 25.0, 3, 2),
            ('c', 4, 75.0, 25.0, 5, 2),
        ),
    ),
}
