"""The taxonomy of sectors: which macro sector an industry is of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Macro sectors and the industries of each.
SECTORS = {
    "Banking & Financial Services": (
        "Private Sector Bank",
        "Non Banking Financial Company (NBFC)",
        "Housing Finance Company",
        "Microfinance Institutions",
        "Financial Institution",
        "Asset Management Company",
        "Stockbroking & Allied",
        "Other Capital Market related Services",
        "Other Financial Services",
        "Investment Company",
    ),
    "Energy": (
        "Oil Exploration & Production",
        "Refineries & Marketing",
        "Oil Equipment & Services",
        "Oil Storage & Transportation",
        "LPG/CNG/PNG/LNG Supplier",
        "Power Generation",
        "Integrated Power Utilities",
        "Power Distribution",
        "Power Trading",
        "Power - Transmission",
        "Other Utilities",
        "Offshore Support Solution Drilling",
    ),
    "Metals & Mining": (
        "Iron & Steel",
        "Iron & Steel Products",
        "Aluminium",
        "Copper",
        "Zinc",
        "Diversified Metals",
        "Ferro & Silica Manganese",
        "Sponge Iron",
        "Pig Iron",
        "Precious Metals",
        "Coal",
        "Trading - Metals",
        "Trading - Minerals",
        "Industrial Minerals",
        "Aluminium, Copper & Zinc Products",
        "Trading - Coal",
    ),
    "Automobiles & Auto Components": (
        "Passenger Cars & Utility Vehicles",
        "Commercial Vehicles",
        "2/3 Wheelers",
        "Auto Components & Equipments",
        "Tractors",
        "Auto Dealer",
        "Dealers-Commercial Vehicles, Tractors, Construction Vehicles",
        "Trading - Auto Components",
        "Cycles",
        "Tyres & Rubber Products",
    ),
    "Pharmaceuticals & Healthcare": (
        "Pharmaceuticals",
        "Biotechnology",
        "Healthcare Service Provider",
        "Medical Equipment & Supplies",
        "Healthcare Research, Analytics & Technology",
        "Hospital",
    ),
    "IT & Technology": (
        "Computers - Software & Consulting",
        "IT Enabled Services",
        "Business Process Outsourcing (BPO)/ Knowledge Process Outsourcing (KPO)",
        "Data Processing Services",
        "Computers Hardware & Equipments",
        "Telecom - Equipment & Accessories",
        "Telecom - Cellular & Fixed line services",
        "Telecom - Infrastructure",
        "Consulting Services",
    ),
    "Chemicals & Petrochemicals": (
        "Specialty Chemicals",
        "Commodity Chemicals",
        "Petrochemicals",
        "Dyes And Pigments",
        "Pesticides & Agrochemicals",
        "Fertilizers",
        "Carbon Black",
        "Explosives",
        "Industrial Gases",
        "Lubricants",
        "Paints",
        "Trading - Chemicals",
    ),
    "FMCG & Consumer Goods": (
        "Diversified FMCG",
        "Packaged Foods",
        "Other Food Products",
        "Personal Care",
        "Household Products",
        "Household Appliances",
        "Consumer Electronics",
        "Diversified Retail",
        "Speciality Retail",
        "Houseware",
        "Stationary",
        "Leisure Products",
    ),
    "Infrastructure & Construction": (
        "Civil Construction",
        "Cement & Cement Products",
        "Road Assets-Toll, Annuity, Hybrid-Annuity",
        "Road Transport",
        "Other Construction Materials",
        "Airport & Airport services",
        "Railway Wagons",
        "Water Supply & Management",
        "Dredging",
        "Waste Management",
        "Other Electrical Equipment",
        "Electrodes & Refractories",
    ),
    "Real Estate": (
        "Real Estate Investment Trusts (REITs)",
        "Real Estate related services",
        "Residential, Commercial Projects",
        "Furniture, Home Furnishing",
        "Granites & Marbles",
        "Plywood Boards/ Laminates",
        "Ceramics",
    ),
    "Media & Entertainment": (
        "Media & Entertainment",
        "TV Broadcasting & Software Production",
        "Film Production, Distribution & Exhibition",
        "Print Media",
        "Advertising & Media Agencies",
        "Printing & Publication",
        "Amusement Parks/ Other Recreation",
        "Other Consumer Services",
    ),
    "Agriculture & Food Processing": (
        "Sugar",
        "Tea & Coffee",
        "Edible Oil",
        "Dairy Products",
        "Seafood",
        "Meat Products including Poultry",
        "Animal Feed",
        "Other Agricultural Products",
        "Other Beverages",
        "Breweries & Distilleries",
        "Cigarettes & Tobacco Products",
        "Restaurants",
    ),
    "Logistics & Transport": (
        "Logistics Solution Provider",
        "Shipping",
        "Transport Related Services",
        "Tour, Travel Related Services",
        "Airline",
    ),
    "Textiles & Apparel": (
        "Garments & Apparels",
        "Other Textile Products",
        "Trading - Textile Products",
        "Leather And Leather Products",
        "Jute & Jute Products",
        "Footwear",
        "Rubber",
    ),
    "Capital Goods & Industrials": (
        "Heavy Electrical Equipment",
        "Compressors, Pumps & Diesel Engines",
        "Castings & Forgings",
        "Abrasives & Bearings",
        "Industrial Products",
        "Other Industrial Products",
        "Aerospace & Defense",
        "Plastic Products - Industrial",
        "Plastic Products - Consumer",
        "Packaging",
        "Paper & Paper Products",
        "Cables - Electricals",
    ),
    "Gems, Jewellery & Luxury": (
        "Gems, Jewellery And Watches",
        "Hotels & Resorts",
        "Education",
    ),
    "Diversified / Conglomerates": (
        "Diversified",
        "Diversified Commercial Services",
        "Trading & Distributors",
        "Distributors",
    ),
}


def taxonomy(spark: SparkSession) -> DataFrame:
    """(industry, macro), a row for each industry."""
    return spark.createDataFrame([(x, macro) for macro, names in SECTORS.items() for x in names], "industry string, macro string")
