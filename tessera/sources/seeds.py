"""Reference tables as small DataFrames; every list's order is kept in `ord`, which decides all first matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Province code, name, kind, aliases, west, south, east, north.
PROVINCES = [
    ("hanoi", "Hà Nội", "city", ["Ha Noi", "Thanh pho Ha Noi"], 105.45, 20.92, 106.05, 21.32),
    ("hue", "Huế", "city", ["Hue", "Thua Thien Hue"], 107.35, 16.12, 108.0, 16.7),
    ("quang-ninh", "Quảng Ninh", "province", ["Tinh Quang Ninh"], 107.25, 20.62, 108.7, 21.42),
    ("cao-bang", "Cao Bằng", "province", ["Tinh Cao Bang"], 105.75, 22.2, 107.1, 23.15),
    ("lang-son", "Lạng Sơn", "province", ["Tinh Lang Son"], 106.75, 21.35, 108.0, 22.18),
    ("lai-chau", "Lai Châu", "province", ["Tinh Lai Chau"], 102.05, 22.1, 103.25, 23.15),
    ("dien-bien", "Điện Biên", "province", ["Tinh Dien Bien"], 102.05, 21.05, 103.2, 22.1),
    ("son-la", "Sơn La", "province", ["Tinh Son La"], 103.2, 21.0, 104.55, 22.1),
    ("thanh-hoa", "Thanh Hóa", "province", ["Tinh Thanh Hoa"], 104.45, 18.95, 105.75, 19.95),
    ("nghe-an", "Nghệ An", "province", ["Tinh Nghe An"], 103.7, 17.95, 105.2, 18.95),
    ("ha-tinh", "Hà Tĩnh", "province", ["Tinh Ha Tinh"], 105.2, 17.35, 106.15, 17.95),
    ("tuyen-quang", "Tuyên Quang", "province", ["Ha Giang", "Tinh Tuyen Quang"], 104.55, 21.65, 105.75, 22.55),
    ("lao-cai", "Lào Cai", "province", ["Yen Bai", "Tinh Lao Cai"], 103.25, 22.1, 104.55, 23.15),
    ("thai-nguyen", "Thái Nguyên", "province", ["Bac Kan", "Tinh Thai Nguyen"], 105.75, 21.55, 106.75, 22.18),
    ("phu-tho", "Phú Thọ", "province", ["Hoa Binh", "Vinh Phuc", "Tinh Phu Tho"], 104.45, 20.9, 105.45, 21.55),
    ("bac-ninh", "Bắc Ninh", "province", ["Bac Giang", "Tinh Bac Ninh"], 106.05, 20.92, 106.75, 21.38),
    ("hung-yen", "Hưng Yên", "province", ["Thai Binh", "Tinh Hung Yen"], 105.75, 20.62, 106.7, 20.92),
    ("hai-phong", "Hải Phòng", "city", ["Hai Duong", "Thanh pho Hai Phong"], 106.75, 20.02, 107.55, 20.62),
    ("ninh-binh", "Ninh Bình", "province", ["Ha Nam", "Nam Dinh", "Tinh Ninh Binh"], 105.35, 19.95, 106.2, 20.62),
    ("quang-tri", "Quảng Trị", "province", ["Quang Binh", "Tinh Quang Tri"], 106.15, 16.55, 107.35, 17.95),
    ("da-nang", "Đà Nẵng", "city", ["Quang Nam", "Thanh pho Da Nang"], 108.0, 15.72, 108.62, 16.12),
    ("quang-ngai", "Quảng Ngãi", "province", ["Kon Tum", "Tinh Quang Ngai"], 107.35, 14.65, 108.82, 15.72),
    ("gia-lai", "Gia Lai", "province", ["Binh Dinh", "Tinh Gia Lai"], 107.45, 13.35, 108.95, 14.65),
    ("khanh-hoa", "Khánh Hòa", "province", ["Ninh Thuan", "Tinh Khanh Hoa"], 108.42, 12.02, 109.42, 13.35),
    ("lam-dong", "Lâm Đồng", "province", ["Dak Nong", "Binh Thuan", "Tinh Lam Dong"], 107.1, 10.75, 108.82, 12.02),
    ("dak-lak", "Đắk Lắk", "province", ["Phu Yen", "Tinh Dak Lak"], 107.05, 12.02, 108.42, 13.35),
    ("ho-chi-minh-city", "Thành phố Hồ Chí Minh", "city", ["Sai Gon", "Binh Duong", "Ba Ria Vung Tau", "Thanh pho Ho Chi Minh"], 106.28, 10.38, 107.15, 11.08),
    ("dong-nai", "Đồng Nai", "province", ["Binh Phuoc", "Tinh Dong Nai"], 107.15, 10.42, 108.05, 11.25),
    ("tay-ninh", "Tây Ninh", "province", ["Long An", "Tinh Tay Ninh"], 105.35, 10.62, 106.28, 11.35),
    ("can-tho", "Cần Thơ", "city", ["Soc Trang", "Hau Giang", "Thanh pho Can Tho"], 105.02, 9.4, 105.82, 10.02),
    ("vinh-long", "Vĩnh Long", "province", ["Ben Tre", "Tra Vinh", "Tinh Vinh Long"], 105.82, 9.42, 106.52, 10.02),
    ("dong-thap", "Đồng Tháp", "province", ["Tien Giang", "Tinh Dong Thap"], 105.05, 10.02, 105.82, 10.72),
    ("ca-mau", "Cà Mau", "province", ["Bac Lieu", "Tinh Ca Mau"], 104.42, 8.2, 105.72, 9.4),
    ("an-giang", "An Giang", "province", ["Kien Giang", "Tinh An Giang"], 104.35, 9.78, 105.05, 10.72),
]

# Description of each province, in the order above.
DESCRIPTIONS = [
    "Thủ đô và trung tâm chính trị, hành chính của cả nước.",
    "Thành phố di sản ở khu vực miền Trung.",
    "Tỉnh ven biển Đông Bắc, nổi bật với Vịnh Hạ Long và kinh tế cửa khẩu.",
    "Tỉnh miền núi biên giới ở phía Bắc.",
    "Tỉnh biên giới phía Bắc, giữ vai trò kết nối thương mại quan trọng.",
    "Tỉnh miền núi Tây Bắc với địa hình đồi núi đặc trưng.",
    "Tỉnh biên giới Tây Bắc gắn với các giá trị lịch sử và văn hóa đặc sắc.",
    "Tỉnh miền núi Tây Bắc có không gian nông nghiệp và du lịch sinh thái rộng lớn.",
    "Tỉnh Bắc Trung Bộ có quy mô dân số, diện tích và hạ tầng kết nối lớn.",
    "Tỉnh Bắc Trung Bộ có diện tích lớn và vai trò kết nối liên vùng quan trọng.",
    "Tỉnh Bắc Trung Bộ với thế mạnh công nghiệp, cảng biển và kết nối Bắc - Nam.",
    "Tỉnh Tuyên Quang sau sắp xếp, bao gồm không gian Tuyên Quang và Hà Giang trước đây.",
    "Tỉnh Lào Cai sau sắp xếp, bao gồm không gian Lào Cai và Yên Bái trước đây.",
    "Tỉnh Thái Nguyên sau sắp xếp, bao gồm không gian Thái Nguyên và Bắc Kạn trước đây.",
    "Tỉnh Phú Thọ sau sắp xếp, bao gồm không gian Phú Thọ, Vĩnh Phúc và Hòa Bình trước đây.",
    "Tỉnh Bắc Ninh sau sắp xếp, bao gồm không gian Bắc Ninh và Bắc Giang trước đây.",
    "Tỉnh Hưng Yên sau sắp xếp, bao gồm không gian Hưng Yên và Thái Bình trước đây.",
    "Thành phố Hải Phòng sau sắp xếp, bao gồm không gian Hải Phòng và Hải Dương trước đây.",
    "Tỉnh Ninh Bình sau sắp xếp, bao gồm không gian Ninh Bình, Hà Nam và Nam Định trước đây.",
    "Tỉnh Quảng Trị sau sắp xếp, bao gồm không gian Quảng Trị và Quảng Bình trước đây.",
    "Thành phố Đà Nẵng sau sắp xếp, bao gồm không gian Đà Nẵng và Quảng Nam trước đây.",
    "Tỉnh Quảng Ngãi sau sắp xếp, bao gồm không gian Quảng Ngãi và Kon Tum trước đây.",
    "Tỉnh Gia Lai sau sắp xếp, bao gồm không gian Gia Lai và Bình Định trước đây.",
    "Tỉnh Khánh Hòa sau sắp xếp, bao gồm không gian Khánh Hòa và Ninh Thuận trước đây.",
    "Tỉnh Lâm Đồng sau sắp xếp, bao gồm không gian Lâm Đồng, Đắk Nông và Bình Thuận trước đây.",
    "Tỉnh Đắk Lắk sau sắp xếp, bao gồm không gian Đắk Lắk và Phú Yên trước đây.",
    "Thành phố Hồ Chí Minh sau sắp xếp, bao gồm không gian Thành phố Hồ Chí Minh, Bình Dương và Bà Rịa - Vũng Tàu trước đây.",
    "Tỉnh Đồng Nai sau sắp xếp, bao gồm không gian Đồng Nai và Bình Phước trước đây.",
    "Tỉnh Tây Ninh sau sắp xếp, bao gồm không gian Tây Ninh và Long An trước đây.",
    "Thành phố Cần Thơ sau sắp xếp, bao gồm không gian Cần Thơ, Sóc Trăng và Hậu Giang trước đây.",
    "Tỉnh Vĩnh Long sau sắp xếp, bao gồm không gian Vĩnh Long, Bến Tre và Trà Vinh trước đây.",
    "Tỉnh Đồng Tháp sau sắp xếp, bao gồm không gian Đồng Tháp và Tiền Giang trước đây.",
    "Tỉnh Cà Mau sau sắp xếp, bao gồm không gian Cà Mau và Bạc Liêu trước đây.",
    "Tỉnh An Giang sau sắp xếp, bao gồm không gian An Giang và Kiên Giang trước đây.",
]

# Names of the former 63 provinces, current province code.
FORMER_NAMES = [
    ("Hà Nội", "hanoi"),
    ("Thừa Thiên - Huế", "hue"),
    ("Quảng Ninh", "quang-ninh"),
    ("Cao Bằng", "cao-bang"),
    ("Lạng Sơn", "lang-son"),
    ("Lai Châu", "lai-chau"),
    ("Điện Biên", "dien-bien"),
    ("Sơn La", "son-la"),
    ("Thanh Hóa", "thanh-hoa"),
    ("Nghệ An", "nghe-an"),
    ("Hà Tĩnh", "ha-tinh"),
    ("Tuyên Quang", "tuyen-quang"),
    ("Hà Giang", "tuyen-quang"),
    ("Lào Cai", "lao-cai"),
    ("Yên Bái", "lao-cai"),
    ("Thái Nguyên", "thai-nguyen"),
    ("Bắc Kạn", "thai-nguyen"),
    ("Phú Thọ", "phu-tho"),
    ("Vĩnh Phúc", "phu-tho"),
    ("Hòa Bình", "phu-tho"),
    ("Bắc Ninh", "bac-ninh"),
    ("Bắc Giang", "bac-ninh"),
    ("Hưng Yên", "hung-yen"),
    ("Thái Bình", "hung-yen"),
    ("Hải Phòng", "hai-phong"),
    ("Hải Dương", "hai-phong"),
    ("Ninh Bình", "ninh-binh"),
    ("Hà Nam", "ninh-binh"),
    ("Nam Định", "ninh-binh"),
    ("Quảng Trị", "quang-tri"),
    ("Quảng Bình", "quang-tri"),
    ("Đà Nẵng", "da-nang"),
    ("Quảng Nam", "da-nang"),
    ("Quảng Ngãi", "quang-ngai"),
    ("Kon Tum", "quang-ngai"),
    ("Gia Lai", "gia-lai"),
    ("Bình Định", "gia-lai"),
    ("Khánh Hòa", "khanh-hoa"),
    ("Ninh Thuận", "khanh-hoa"),
    ("Lâm Đồng", "lam-dong"),
    ("Đăk Nông", "lam-dong"),
    ("Bình Thuận", "lam-dong"),
    ("Đắk Lắk", "dak-lak"),
    ("Phú Yên", "dak-lak"),
    ("Hồ Chí Minh City", "ho-chi-minh-city"),
    ("Hồ Chí Minh city", "ho-chi-minh-city"),
    ("Bình Dương", "ho-chi-minh-city"),
    ("Bà Rịa - Vũng Tàu", "ho-chi-minh-city"),
    ("Đồng Nai", "dong-nai"),
    ("Bình Phước", "dong-nai"),
    ("Tây Ninh", "tay-ninh"),
    ("Long An", "tay-ninh"),
    ("Cần Thơ", "can-tho"),
    ("Sóc Trăng", "can-tho"),
    ("Hậu Giang", "can-tho"),
    ("Vĩnh Long", "vinh-long"),
    ("Bến Tre", "vinh-long"),
    ("Trà Vinh", "vinh-long"),
    ("Đồng Tháp", "dong-thap"),
    ("Tiền Giang", "dong-thap"),
    ("Cà Mau", "ca-mau"),
    ("Bạc Liêu", "ca-mau"),
    ("An Giang", "an-giang"),
    ("Kiên Giang", "an-giang"),
]

# Commune code, name, type, province code, aliases.
COMMUNES = [
    ("hanoi-ba-dinh", "phường Ba Đình", "phuong", "hanoi", ["Ba Dinh Ward", "Phuong Ba Dinh"]),
    ("hanoi-dong-da", "phường Đống Đa", "phuong", "hanoi", ["Dong Da Ward", "Phuong Dong Da"]),
    ("hue-phu-hoi", "phường Phú Hội", "phuong", "hue", ["Phu Hoi Ward", "Phuong Phu Hoi"]),
    ("hue-huong-thuy", "phường Hương Thủy", "phuong", "hue", ["Huong Thuy Ward", "Thi xa Huong Thuy"]),
    ("hai-phong-hong-bang", "phường Hồng Bàng", "phuong", "hai-phong", ["Hong Bang Ward", "Phuong Hong Bang"]),
    ("hai-phong-kien-an", "phường Kiến An", "phuong", "hai-phong", ["Kien An Ward", "Phuong Kien An"]),
    ("da-nang-hai-chau", "phường Hải Châu", "phuong", "da-nang", ["Hai Chau Ward", "Phuong Hai Chau"]),
    ("da-nang-hoa-vang", "xã Hòa Vang", "xa", "da-nang", ["Hoa Vang Commune", "Xa Hoa Vang"]),
    ("hcm-ben-thanh", "phường Bến Thành", "phuong", "ho-chi-minh-city", ["Ben Thanh Ward", "Phuong Ben Thanh"]),
    ("hcm-thu-duc", "phường Thủ Đức", "phuong", "ho-chi-minh-city", ["Thu Duc Ward", "Thanh pho Thu Duc", "Phuong Phu Hoa", "phường Phú Hòa"]),
    ("can-tho-ninh-kieu", "phường Ninh Kiều", "phuong", "can-tho", ["Ninh Kieu Ward", "Phuong Ninh Kieu"]),
    ("can-tho-phong-dien", "xã Phong Điền", "xa", "can-tho", ["Phong Dien Commune", "Xa Phong Dien"]),
]

# Legacy province name, current province code.
LEGACY_PROVINCES = [
    ("Ha Giang", "tuyen-quang"), ("Yen Bai", "lao-cai"), ("Bac Kan", "thai-nguyen"), ("Vinh Phuc", "phu-tho"), ("Hoa Binh", "phu-tho"),
    ("Bac Giang", "bac-ninh"), ("Thai Binh", "hung-yen"), ("Hai Duong", "hai-phong"), ("Ha Nam", "ninh-binh"), ("Nam Dinh", "ninh-binh"),
    ("Quang Binh", "quang-tri"), ("Quang Nam", "da-nang"), ("Kon Tum", "quang-ngai"), ("Binh Dinh", "gia-lai"), ("Ninh Thuan", "khanh-hoa"),
    ("Dak Nong", "lam-dong"), ("Binh Thuan", "lam-dong"), ("Phu Yen", "dak-lak"), ("Binh Duong", "ho-chi-minh-city"), ("Ba Ria Vung Tau", "ho-chi-minh-city"),
    ("Ba Ria - Vung Tau", "ho-chi-minh-city"), ("Binh Phuoc", "dong-nai"), ("Long An", "tay-ninh"), ("Soc Trang", "can-tho"), ("Hau Giang", "can-tho"),
    ("Ben Tre", "vinh-long"), ("Tra Vinh", "vinh-long"), ("Tien Giang", "dong-thap"), ("Bac Lieu", "ca-mau"), ("Kien Giang", "an-giang"),
]

# Legacy commune, district, province, current commune code, mapping type, whether it is the default.
LEGACY_COMMUNES = [
    ("Phường Phú Hòa", "Thủ Dầu Một", "Bình Dương", "hcm-thu-duc", "many_to_one", True),
    ("Phường Bến Nghé", "Quận 1", "Thành phố Hồ Chí Minh", "hcm-ben-thanh", "one_to_many", True),
    ("Phường Hòa Hải", "Ngũ Hành Sơn", "Quảng Nam", "da-nang-hai-chau", "many_to_one", True),
    ("Phường 1", "Thành phố Sóc Trăng", "Sóc Trăng", "can-tho-ninh-kieu", "many_to_one", True),
    ("Thị xã Hương Thủy", None, "Huế", "hue-huong-thuy", "alias", True),
]

# Zone, latitude and longitude bounds, current commune and province, legacy commune, district and province.
ZONES = [
    ("hanoi-core", 21.0, 21.12, 105.76, 105.9, "phường Ba Đình", "thành phố Hà Nội", "phường Ba Đình", "quận Ba Đình", "thành phố Hà Nội"),
    ("hcm-legacy-binh-duong", 10.86, 11.08, 106.63, 106.84, "phường Thủ Đức", "Thành phố Hồ Chí Minh", "phường Phú Hòa", "thành phố Thủ Dầu Một", "tỉnh Bình Dương"),
    ("hcm-center", 10.72, 10.82, 106.65, 106.75, "phường Bến Thành", "Thành phố Hồ Chí Minh", "phường Bến Thành", "Quận 1", "Thành phố Hồ Chí Minh"),
    ("da-nang-legacy", 15.98, 16.12, 108.16, 108.32, "phường Hải Châu", "thành phố Đà Nẵng", "phường Hòa Hải", "quận Ngũ Hành Sơn", "tỉnh Quảng Nam"),
    ("hue-core", 16.42, 16.5, 107.54, 107.67, "phường Phú Hội", "thành phố Huế", "phường Phú Hội", "thành phố Huế", "thành phố Huế"),
    ("can-tho-legacy", 9.95, 10.1, 105.72, 105.86, "phường Ninh Kiều", "thành phố Cần Thơ", "Phường 1", "thành phố Sóc Trăng", "tỉnh Sóc Trăng"),
]


def strips() -> list[tuple]:
    """Communes with their boxes: a province's box in equal bands from south to north, to 5 decimals."""
    out = []
    for code, *_, west, south, east, north in PROVINCES:
        own = [c for c in COMMUNES if c[3] == code]
        step = (north - south) / max(len(own), 1)
        for i, c in enumerate(own):
            out.append((len(out) + 1, *c, west, round(south + i * step, 5), east, round(south + (i + 1) * step, 5)))
    return out


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).coalesce(1)


def provinces(spark: SparkSession) -> DataFrame:
    rows = [(i, f"p-{i:03d}", *p, d) for i, (p, d) in enumerate(zip(PROVINCES, DESCRIPTIONS, strict=True), 1)]
    return _frame(spark, rows, "ord int, province_id string, province_code string, province_name string, province_kind string, aliases array<string>, west double, south double, east double, north double, description string")


def communes(spark: SparkSession) -> DataFrame:
    return _frame(spark, strips(), "ord int, commune_code string, commune_name string, commune_type string, province_code string, aliases array<string>, west double, south double, east double, north double")


def legacy_provinces(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(i, *p) for i, p in enumerate(LEGACY_PROVINCES, 1)], "ord int, legacy_province_name string, current_province_code string")


def legacy_communes(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(i, *p) for i, p in enumerate(LEGACY_COMMUNES, 1)], "ord int, legacy_commune_name string, legacy_district_name string, legacy_province_name string, current_commune_code string, mapping_type string, is_default boolean")


def zones(spark: SparkSession) -> DataFrame:
    return _frame(spark, [(i, *z) for i, z in enumerate(ZONES, 1)], "ord int, zone string, lat_min double, lat_max double, lon_min double, lon_max double, current_commune string, current_province string, legacy_commune string, legacy_district string, legacy_province string")


def former_names(spark: SparkSession) -> DataFrame:
    return _frame(spark, FORMER_NAMES, "name string, province_code string")


def _checked(rows: DataFrame, sound: Column, need: str) -> DataFrame:
    """rows, if an aggregate over them is true; a check at load, as the tables are small."""
    if not rows.agg(F.coalesce(sound, F.lit(False))).first()[0]:
        raise ValueError(need)
    return rows


def _filled(*columns: str) -> Column:
    return F.min(reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in columns]))


def _boxed() -> Column:
    return F.min(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("west", "south", "east", "north")]))


def checked_provinces(rows: DataFrame | SparkSession) -> DataFrame:
    """The provinces, of which there must be 34, each with a code, a name and a box."""
    rows = rows if isinstance(rows, DataFrame) else provinces(rows)
    return _checked(rows, (F.count("*") == 34) & _filled("province_code", "province_name") & _boxed(), "34 provinces with code, name and box are needed")


def checked_communes(rows: DataFrame | SparkSession) -> DataFrame:
    """The communes, of which there must be some, each with a code, a province and a box."""
    rows = rows if isinstance(rows, DataFrame) else communes(rows)
    return _checked(rows, _filled("commune_code", "province_code") & _boxed(), "communes with code, province and box are needed")


def checked_features(features: DataFrame, n: int | None = 34) -> DataFrame:
    """Features, a row each with their collection's type in `collection`, which must be FeatureCollection; there must be
    n of them, or some."""
    right = F.count("*") > 0 if n is None else F.count("*") == n
    return _checked(features, right & F.min(F.col("collection") == "FeatureCollection"), f"a FeatureCollection of {n or 'some'} features is needed")
